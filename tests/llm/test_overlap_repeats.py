"""Repeated rows, and rows without an id, have the same overlaps by the join as by the broadcast index."""

from collections import Counter

from vellum.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_repeated_rows(spark):
    held = f"before that {ITEM} and after it"
    near = f"other words {ITEM.replace('six', 'sixty')} close it"
    rows = [(1, held), (1, held), (1, near), (2, "nothing of the kind"), (None, held), (None, held), (None, near), (None, None), (3, ""), (4, near), (4, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, ITEM), (7, ITEM), (9, None)], "item_id long, text string")
    plain, joined = (Counter(map(tuple, decontaminate.find_overlaps(docs, bench, n).collect())) for n in (10**6, 0))
    assert plain == joined and sum(joined.values()) == 2 * 8
    kept = [Counter(map(tuple, decontaminate.decontaminate(docs, bench, n).collect())) for n in (10**6, 0)]
    assert kept[0] == kept[1] == Counter([(2, "nothing of the kind"), (None, None), (3, "")])
    assert not decontaminate.find_overlaps(docs.limit(0), bench, 0).count() and not decontaminate.find_overlaps(docs, bench.limit(0), -1).count()
