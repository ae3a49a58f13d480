"""Leaks by window: clashes cost their windows only, and windows poor in plain words count."""

from pulseframe.llm import decontaminate

ITEM = ("A tank is filled by the first pipe in 2 hours and by the second pipe in 3 hours while the third pipe empties it in 45 minutes , "
        "so how long does it take to fill the whole tank when all of them are open ?")
FIXED = ["Compute 12 + 7 * 3 - 4 / 2 = 31", "Solve: 3 x 4 + 5 x 6 + 7 = 49 and give 2 digits"]


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, **options).collect()}


def test_a_clash_costs_its_windows_only(spark):
    one = ITEM.replace("3 hours", "2 hours")  # a value that stands elsewhere
    alike = ITEM.replace("2 hours", "4 hours").replace("3 hours", "4 hours").replace("45 minutes", "4 minutes")
    equal = ITEM.replace("3 hours", "2 hours")
    changed = equal.replace("second pipe in 2 hours", "second pipe in 5 hours")
    found = leaks(spark, [ITEM, one, alike, changed, "A tank of 3 hours and 2 hours is empty"], [ITEM, equal])
    assert {(i, 0) for i in range(4)} <= set(found) and (3, 1) in found and not any(i == 4 for i, _ in found)
    assert found[0, 0].coverage == 1.0 and found[0, 0].same_values
    assert found[2, 0].coverage == 1.0 and not found[2, 0].same_values
    assert 0.6 <= found[3, 1].coverage < 1.0 and not found[3, 1].same_values


def test_items_poor_in_plain_words_cover_themselves(spark):
    docs = [*FIXED, "Some words. " + FIXED[0] + " and more.", FIXED[0].replace("7", "8").replace("12", "9").replace("31", "5")]
    found = leaks(spark, docs, FIXED)
    assert set(found) == {(0, 0), (1, 1), (2, 0)}
    assert all(r.coverage == 1.0 for r in found.values())
