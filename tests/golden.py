"""Fixed pairs of what a user types and the tag it means (None: nothing)."""

GOLDEN = [
    ("ツインみつあみ", "twin_braids"), ("ツインミツアミ", "twin_braids"), ("ついんみつあみ", "twin_braids"), ("ツイン三つ編み", "twin_braids"), ("みつあみ", "braid"),
    ("ミツアミ", "braid"), ("三つ編み", "braid"), ("3つ編み", "braid"), ("三つ網", "braid"), ("あみこみ", "braid"), ("おだんご", "hair_bun"),
    ("オダンゴ", "hair_bun"), ("ツインおだんご", "double_bun"), ("ツインお団子", "double_bun"), ("サイドみつあみ", "side_braid"), ("サイドおだんご", "single_side_bun"),
    ("サイドドリル", "side_drill"), ("ローツインテール", "low_twintails"), ("低ツインテール", "low_twintails"), ("ハイポニーテール", "high_ponytail"),
    ("ハイサイドポニー", "high_side_ponytail"), ("両みつあみ", "twin_braids"), ("一本三つ編み", "single_braid"), ("ショートツインテール", "short_twintails"),
    ("ショートポニーテール", "short_ponytail"), ("ロング三つ編み", "long_braid"), ("ロングみつあみ", "long_braid"), ("おさげ", "twin_braids"), ("二つ結び", "twintails"),
    ("ひとつ結び", "ponytail"), ("編みおろし", "single_braid"), ("マッシュ", "bowl_cut"), ("オン眉", "short_bangs"), ("おんまゆ", "short_bangs"),
    ("切りっぱなし", "blunt_ends"), ("オールバック", "hair_slicked_back"), ("インテーク", "hair_intakes"), ("ベリーショート", "very_short_hair"),
    ("ツーブロック", "undercut"), ("モヒカン", "mohawk"), ("ちょんまげ", "topknot"), ("ドレッド", "dreadlocks"), ("無造作", "messy_hair"),
    ("アシメ", "asymmetrical_hair"), ("カーテンバング", "curtained_hair"), ("編み込みお団子", "braided_bun"), ("あみこみおだんご", "braided_bun"),
    ("ポンパドール", "pompadour"), ("アフロ", "afro"), ("前髪ポンパ", "bangs_pinned_back"), ("片側上げ", "asymmetrical_bangs"), ("ツインテール", "twintails"),
    ("ツインテ", "twintails"), ("ぱっつん", "blunt_bangs"), ("ポニテ", "ponytail"), ("縦ロール", "drill_hair"), ("ボブ", "bob_cut"),
    ("twintails", "twintails"), ("bob", "bob_cut"), ("braid", "braid"), ("ロングヘアー", "long_hair"), ("ウェーブヘアー", "wavy_hair"),
    ("セミロング", "medium_hair"), ("", None), ("存在しない髪型語", None),
]
