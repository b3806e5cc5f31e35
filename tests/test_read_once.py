"""The repeated check works on tables that were made once, not on documents at each step."""

import pytest

from vellum.operators import recheck
from vellum.plans.queries import QUERIES


class Seen(Exception):
    pass


def test_documents_are_read_before_the_checks(spark, sf, monkeypatch):
    def look(spark, root, records, files, paths):
        raise Seen([f for d in (records, files, paths) for f in d.inputFiles()])

    monkeypatch.setattr(recheck, "update", look)
    with pytest.raises(Seen) as seen:
        QUERIES["check_again"](spark, sf)
    files = seen.value.args[0]
    assert files and not any("documents" in f for f in files)
