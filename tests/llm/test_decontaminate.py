"""Copies of benchmark items in other cases, with values that coincide, and with words put in."""

import pytest

ITEM = "A train leaves with Anna and 120 km to go while Anna walks 5 km to the old station near the river."
PLAIN = "we know that a train leaves with 120 km to go while another walks 5 km to the old station near the river"
NAMES = "we ask Anna and Berta whether Clara or Doris would walk to Paris before Emma meets Fiona in old Rome"


def found(spark, item, text):
    from tagweave.llm import decontaminate

    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return decontaminate.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first().contaminated


@pytest.mark.parametrize("text", [PLAIN.upper(), PLAIN.title(), ITEM.upper(), ITEM.lower()])
def test_other_case(spark, text):
    assert found(spark, PLAIN if text.lower() == PLAIN else ITEM, text)


def test_lower_case_of_many_names(spark):
    assert found(spark, NAMES, NAMES.lower())


def test_two_values_become_one(spark):
    assert found(spark, ITEM, ITEM.replace("120", "7").replace("5 km", "7 km"))


def test_one_of_two_equal_numbers_changed(spark):
    item = "first take 3 apples and put them all into the large red box by the door and then wait until noon before you go home and take 3 pears"
    assert found(spark, item, item[: item.rindex("3")] + "4" + item[item.rindex("3") + 1 :])


def test_word_put_in(spark):
    item = "we went up the long hill by foot and saw our small house over there with its wide green garden"
    words = item.split()
    copy = " ".join([*words[:9], "really", *words[9:18], "rather", *words[18:]])
    assert found(spark, item, copy)


def test_unlike_texts_stay_clean(spark):
    assert not found(spark, ITEM, ITEM.replace("120 km", "7 miles").replace("Anna walks", "Berta walks"))


def test_items_of_numbers_and_names(spark):
    item = "12 km 13 km 14 km 15 km 16 km 17 km"
    assert found(spark, item, f"Table: {item} end")
    assert not found(spark, item, f"Table: {item.replace('1', '2')} end")
    names = "Anna Berta Clara Doris Emma Fiona Greta Hanna Ida"
    assert found(spark, names, f"They are {names} here.")
    assert not found(spark, names, "They are Xenia Yvonne Zoe Wanda Vera Uta Tina Sina Rita here.")


def test_items_of_hardly_a_word(spark):
    """They are reported, but do not contaminate; the least number of words is a parameter."""
    from tagweave.llm import decontaminate

    bench = spark.createDataFrame([(1, "Yes"), (2, "42"), (3, "the cat ran home"), (4, "")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Yes, it is 42 here."), (2, "So the cat ran home today."), (3, "Nothing."), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids, r.short_item_ids) for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {1: (False, [], [1, 2]), 2: (True, [3], []), 3: (False, [], []), 4: (False, [], [])}
    assert {r.doc_id for r in decontaminate.keep_clean(d, bench).collect()} == {1, 3, 4}
    assert {r.doc_id for r in decontaminate.keep_clean(d, bench, min_words=1).collect()} == {3, 4}


def test_passes_over_the_documents(spark):
    """Several blocks of hashes find what one finds."""
    from tagweave.llm import decontaminate

    bench = spark.createDataFrame([(i, f"we saw {' '.join(f'thing{i}x{k}' for k in range(12))} today") for i in range(9)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"a text: we saw {' '.join(f'thing{i}x{k}' for k in range(12))} today") for i in range(0, 20, 2)], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contaminated(d, bench, max_sent=7).collect()}
    assert got == {i: [i] if i < 9 else [] for i in range(0, 20, 2)}
