"""The hair dictionary: vocabulary, synonyms, compounds and seed names."""

#: The curated tags, sorted.
VOCAB = (
    "absurdly_long_hair", "afro", "ahoge", "antenna_hair", "arched_bangs", "asymmetrical_bangs", "asymmetrical_hair",
    "asymmetrical_sidelocks", "bangs_pinned_back", "big_hair", "blunt_bangs", "blunt_ends", "bob_cut", "bowl_cut", "braid", "braided_bangs",
    "braided_bun", "braided_hair_rings", "braided_ponytail", "buzz_cut", "choppy_bangs", "cone_hair_bun", "cowlick", "crossed_bangs",
    "crown_braid", "curly_hair", "curtained_hair", "diagonal_bangs", "double-parted_bangs", "double_bun", "doughnut_hair_bun", "dreadlocks",
    "drill_hair", "drill_sidelocks", "flipped_hair", "folded_hair", "folded_ponytail", "french_braid", "front_ponytail",
    "hair_between_eyes", "hair_bun", "hair_flaps", "hair_intakes", "hair_over_eyes", "hair_over_one_eye", "hair_pulled_back", "hair_rings",
    "hair_slicked_back", "hair_wings", "half_updo", "heart_ahoge", "high_ponytail", "high_side_ponytail", "hime_cut", "huge_ahoge",
    "long_bangs", "long_braid", "long_hair", "low-braided_long_hair", "low-tied_long_hair", "low-tied_sidelocks", "low_ponytail",
    "low_twin_braids", "low_twintails", "medium_bangs", "medium_hair", "messy_hair", "mohawk", "multi-tied_hair", "multiple_braids", "nape",
    "one_side_up", "parted_bangs", "parted_hair", "pointy_hair", "pompadour", "ponytail", "ringlets", "short_bangs", "short_hair",
    "short_hair_with_long_locks", "short_ponytail", "short_twintails", "side_braid", "side_braids", "side_drill", "side_ponytail",
    "sidelocks", "single_braid", "single_hair_bun", "single_hair_ring", "single_side_bun", "single_sidelock", "spiked_hair",
    "split_ponytail", "straight_hair", "swept_bangs", "topknot", "tri_braids", "twin_braids", "twin_drills", "twintails", "two_side_up",
    "undercut", "uneven_twintails", "updo", "very_long_hair", "very_short_hair", "wavy_hair", "wide_ponytail",
)
#: What a surface form means, in the order in which later forms win.
SYNONYMS = {
    "ロング": "long_hair", "ロングヘア": "long_hair", "ロングヘアー": "long_hair", "長い": "long_hair", "長髪": "long_hair", "超ロング": "very_long_hair",
    "すごく長い": "very_long_hair", "ロングロング": "very_long_hair", "ショート": "short_hair", "ショートヘア": "short_hair", "短い": "short_hair",
    "短髪": "short_hair", "ミディアム": "medium_hair", "ミディ": "medium_hair", "セミロング": "medium_hair", "ミディアムヘア": "medium_hair",
    "ぱっつん": "blunt_bangs", "パッツン": "blunt_bangs", "ぱっつん前髪": "blunt_bangs", "ふれ": "blunt_bangs", "流し前髪": "swept_bangs",
    "斜め前髪": "swept_bangs", "サイドバング": "swept_bangs", "分け前髪": "parted_bangs", "センター分け": "parted_bangs", "目隠れ": "hair_over_eyes",
    "目が隠れる": "hair_over_eyes", "片目隠れ": "hair_over_one_eye", "ポニーテール": "ponytail", "ポニテ": "ponytail", "ポニー": "ponytail",
    "ハイポニー": "high_ponytail", "高ポニー": "high_ponytail", "ローポニー": "low_ponytail", "低ポニー": "low_ponytail", "サイドテール": "side_ponytail",
    "サイドポニー": "side_ponytail", "ツインテール": "twintails", "ツインテ": "twintails", "ツイン": "twintails", "ローツイン": "low_twintails",
    "低ツイン": "low_twintails", "ツーサイドアップ": "two_side_up", "サイドアップ": "one_side_up", "三つ編み": "braid", "みつあみ": "braid", "編み込み": "braid",
    "ブレイド": "braid", "ツイン三つ編み": "twin_braids", "両三つ編み": "twin_braids", "一本三つ編み": "single_braid", "フレンチブレイド": "french_braid",
    "お団子": "hair_bun", "おだんご": "hair_bun", "だんご": "hair_bun", "団子": "hair_bun", "ツインお団子": "double_bun", "両お団子": "double_bun",
    "片お団子": "single_hair_bun", "ドリル": "drill_hair", "縦ロール": "drill_hair", "ツインドリル": "twin_drills", "巻き髪": "curly_hair", "カール": "curly_hair",
    "くるくる": "curly_hair", "ウェーブ": "wavy_hair", "ウェーブヘア": "wavy_hair", "波": "wavy_hair", "ストレート": "straight_hair", "さらさら": "straight_hair",
    "外ハネ": "flipped_hair", "はねる": "flipped_hair", "おさげ": "twin_braids", "お下げ": "twin_braids", "二つ結び": "twintails", "ふたつ結び": "twintails",
    "一つ結び": "ponytail", "ひとつ結び": "ponytail", "サイド三つ編み": "side_braid", "横三つ編み": "side_braid", "編みおろし": "single_braid",
    "編み下ろし": "single_braid", "スーパーロング": "absurdly_long_hair", "ベリーショート": "very_short_hair", "ショートカット": "short_hair", "マッシュ": "bowl_cut",
    "マッシュルームカット": "bowl_cut", "刈り上げ": "undercut", "ツーブロック": "undercut", "アンダーカット": "undercut", "坊主": "buzz_cut", "丸刈り": "buzz_cut",
    "モヒカン": "mohawk", "ちょんまげ": "topknot", "トップノット": "topknot", "オン眉": "short_bangs", "眉上": "short_bangs", "眉上前髪": "short_bangs",
    "短い前髪": "short_bangs", "長い前髪": "long_bangs", "ロング前髪": "long_bangs", "カーテンバング": "curtained_hair", "アーチ前髪": "arched_bangs",
    "クロス前髪": "crossed_bangs", "交差前髪": "crossed_bangs", "ギザギザ前髪": "choppy_bangs", "アシメ前髪": "asymmetrical_bangs",
    "片側上げ": "asymmetrical_bangs", "片上げ": "asymmetrical_bangs", "片側かき上げ": "asymmetrical_bangs", "片側前髪上げ": "asymmetrical_bangs",
    "編み込み前髪": "braided_bangs", "切りっぱなし": "blunt_ends", "オールバック": "hair_slicked_back", "かきあげ": "hair_pulled_back", "ボサボサ": "messy_hair",
    "無造作": "messy_hair", "寝ぐせ": "messy_hair", "ツンツン": "spiked_hair", "スパイキー": "spiked_hair", "ドレッド": "dreadlocks", "ドレッドヘア": "dreadlocks",
    "盛り髪": "big_hair", "リングレット": "ringlets", "アシメ": "asymmetrical_hair", "アシンメトリー": "asymmetrical_hair", "ポンパドール": "pompadour",
    "アフロ": "afro", "前髪ポンパ": "bangs_pinned_back", "ポンパ前髪": "bangs_pinned_back", "ポンパ": "bangs_pinned_back", "ハイサイドポニー": "high_side_ponytail",
    "ハイサイドテール": "high_side_ponytail", "インテーク": "hair_intakes", "うなじ": "nape", "ハートアホ毛": "heart_ahoge", "でかアホ毛": "huge_ahoge",
    "巨大アホ毛": "huge_ahoge", "編み込みお団子": "braided_bun", "ドーナツお団子": "doughnut_hair_bun", "クラウンブレイド": "crown_braid", "冠三つ編み": "crown_braid",
    "姫カット": "hime_cut", "姫": "hime_cut", "ボブ": "bob_cut", "ボブカット": "bob_cut", "ショートボブ": "bob_cut", "アホ毛": "ahoge", "あほげ": "ahoge",
    "触角": "antenna_hair", "アンテナ": "antenna_hair", "触覚": "antenna_hair", "もみあげ": "sidelocks", "サイドの髪": "sidelocks", "サイドロック": "sidelocks",
    "ハーフアップ": "half_updo", "まとめ髪": "updo", "アップ": "updo", "twintail": "twintails", "pigtails": "twintails", "bob": "bob_cut",
    "buns": "double_bun", "bun": "hair_bun", "bangs": "blunt_bangs", "wavy": "wavy_hair", "curly": "curly_hair",
    "straight": "straight_hair", "braids": "braid", "drill": "drill_hair",
}
#: The compound of a prefix and a base tag.
COMBOS = {
    ("ツイン", "braid"): "twin_braids", ("ツイン", "hair_bun"): "double_bun", ("ツイン", "drill_hair"): "twin_drills",
    ("ツイン", "ponytail"): "twintails", ("ロー", "twintails"): "low_twintails", ("低", "twintails"): "low_twintails",
    ("ロー", "ponytail"): "low_ponytail", ("低", "ponytail"): "low_ponytail", ("ハイ", "ponytail"): "high_ponytail",
    ("高", "ponytail"): "high_ponytail", ("ハイ", "side_ponytail"): "high_side_ponytail", ("高", "side_ponytail"): "high_side_ponytail",
    ("ロー", "twin_braids"): "low_twin_braids", ("低", "twin_braids"): "low_twin_braids", ("サイド", "braid"): "side_braid",
    ("横", "braid"): "side_braid", ("サイド", "ponytail"): "side_ponytail", ("サイド", "hair_bun"): "single_side_bun",
    ("サイド", "drill_hair"): "side_drill", ("ショート", "ponytail"): "short_ponytail", ("ショート", "twintails"): "short_twintails",
    ("ロング", "braid"): "long_braid", ("片", "hair_bun"): "single_hair_bun", ("両", "hair_bun"): "double_bun", ("両", "braid"): "twin_braids",
    ("一本", "braid"): "single_braid",
}
#: Lower-cased surface forms of entity names and the names themselves.
SEED_NAMES = {
    "sio": "しお", "fiona": "フィオナ", "shinano": "しなの", "manuka": "マヌカ", "chocolat": "ショコラ", "chocolate": "ショコラ", "selestia": "セレスティア",
    "rurune": "ルルネ", "kipfel": "キプフェル", "ramune": "ラムネ", "moe": "萌", "airi": "愛莉", "milltina": "ミルティナ", "milfy": "ミルフィ", "kumaly": "クマリ",
    "eku": "エク", "mayo": "まよ", "lime": "ライム", "minase": "水瀬", "komano": "狛乃", "bokusei": "墨惺", "hanka": "斑霞", "shinra": "森羅",
    "linne": "リンネ", "lumina": "ルミナ", "kalne": "カルネ", "shizune": "雫峰", "nakiya": "泣夜", "anila": "アニラ", "lunary": "ルナリィ", "siusiu": "しうしう",
    "miriam": "ミリアム", "nelfy": "ネルフィ", "nagi": "凪", "marycia": "マリシア", "mao": "真央", "kaguya": "輝夜", "chiffon": "シフォン",
    "rinasciita": "リナシータ", "rokona": "ロコナ", "lapwing": "ラプウィング", "mamehinata": "まめひなた", "io": "イオ", "kanata": "彼方",
}
