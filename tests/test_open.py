"""Which store a scan reads, and the order of a service's hits."""

import json

import pytest

from vellum.sources import services, store


def test_open_store(spark, tmp_path):
    (tmp_path / "a file").write_text("x")
    folder = tmp_path / "gross_1963"
    folder.mkdir()
    (folder / "paper.json").write_text(json.dumps({"key": "gross_1963", "status": "draft", "bibtex": {"type": "book", "fields": {}}}))
    with pytest.raises(ValueError, match="which store"):
        store.open_store(spark)
    for missing in ("none", "a file"):
        with pytest.raises(NotADirectoryError):
            store.scan_records(spark, f"{tmp_path}/{missing}", ["gross_1963"])
    spark.conf.set(store.STORE, str(tmp_path))
    try:
        assert [r["key"] for r in store.scan_records(spark).collect()] == ["gross_1963"]
        assert store.open_store(spark, f"file://{folder}") == f"file://{folder}"
    finally:
        spark.conf.unset(store.STORE)


def test_ranked_works(spark):
    body = json.dumps({"message": {"items": [{"DOI": "10.1/b", "score": 3.5}, {"DOI": "10.1/a"}, {"DOI": "10.1/c", "score": 9.0}]}})
    answers = spark.createDataFrame([(1, body), (2, None), (3, "no json"), (4, '{"message":{"items":[]}}'), (5, body)], "query int, body string")
    rows = services.ranked_works(answers).orderBy("query", "rank").select("query", "rank", "score", "work.DOI").collect()
    assert [tuple(r) for r in rows] == [(q, *hit) for q in (1, 5) for hit in ((0, 3.5, "10.1/b"), (1, 0.0, "10.1/a"), (2, 9.0, "10.1/c"))]
    assert services.ranked_works(answers, 2).count() == 4
