"""Loading drops: unknown fields, bad lines, counts."""

import pytest

from ledgerline.operators import cleaning
from ledgerline.sources import drops, readers
from ledgerline.sources.catalog import SOURCES

CATALOG = {"payments": SOURCES["payments"], "partners": SOURCES["partners"]}


@pytest.fixture
def drop(tmp_path):
    folder = tmp_path / "drop" / SOURCES["payments"].folder
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text(
        '{"accountingDocument": "A1", "amountInTransactionCurrency": 12.5, "rest": "mine", "new": {"deep": [1]}}\n'
        "\n   \nnot json\n42\n[1, 2]\n"
        '{"accountingDocument": null, "customer": true, "later": 3}\n{}\n'
    )
    (folder / "b.jsonl").write_text('{"accountingDocument": "A2", "later": null}\n{"accountingDocument": "cut off\n')
    (folder / "notes.txt").write_text('{"accountingDocument": "A4"}\n')
    return str(tmp_path / "drop")


@pytest.fixture
def loaded(spark, drop, tmp_path):
    return drops.load(spark, drop, str(tmp_path / "out"), CATALOG)


def test_every_key_is_kept(loaded):
    frame = loaded.frames["payments"]
    assert frame.columns == [*SOURCES["payments"].fields, "rest"]
    whole = drops.union_of_keys(frame)
    assert whole.columns == [*SOURCES["payments"].fields, "later", "new", "rest"]
    got = {(r["accountingDocument"], r["customer"], r["later"], r["new"], r["rest"]) for r in whole.collect()}
    assert got == {
        (None, None, None, None, None), (None, "true", "3", None, None), ("A1", None, None, '{"deep":[1]}', "mine"),
        ("A2", None, None, None, None),
    }


def test_cleaned_like_the_plain_scan(spark, drop, loaded):
    plain = cleaning.clean("payments", readers.read_export(spark, drop, SOURCES["payments"]))
    # the plain scan takes the objects of an array as rows of their own
    got = cleaning.clean("payments", loaded.frames["payments"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_bad_lines_are_kept_with_their_file(loaded):
    found = {(r.export, r.line, r.file.rsplit("/", 1)[1]) for r in loaded.quarantine.collect()}
    assert found == {
        ("payments", "not json", "a.jsonl"), ("payments", "42", "a.jsonl"), ("payments", "[1, 2]", "a.jsonl"),
        ("payments", '{"accountingDocument": "cut off', "b.jsonl"),
    }
    assert all(r.modified is not None for r in loaded.quarantine.collect())


def test_profile_is_counted_while_loading(spark, drop, loaded):
    assert sorted(map(tuple, loaded.profile.collect())) == [("partners", 0, 19, 0), ("payments", 4, 6, 4)]
    plain = readers.malformed_lines(spark, drop, SOURCES["payments"]).first().malformed
    assert plain == 4


def test_missing_folder_has_no_rows(loaded):
    assert loaded.frames["partners"].count() == 0
    assert cleaning.clean("partners", loaded.frames["partners"]).columns == ["customer_id", "customer_name", "is_blocked"]


def test_drift(spark, drop):
    found = {r.field: (r.known, r.rows, r.type) for r in drops.drift(spark, drop, {"payments": SOURCES["payments"]}).collect()}
    assert found["accountingDocument"] == (True, 3, "STRING") and found["postingDate"] == (True, 0, None)
    assert found["later"] == (False, 2, "BIGINT") and found["customer"] == (True, 1, "BOOLEAN")
    assert found["new"] == (False, 1, "OBJECT<deep: ARRAY<BIGINT>>") and found["rest"] == (False, 1, "STRING")


def test_too_many_fields_are_an_error(loaded, monkeypatch):
    monkeypatch.setattr(drops, "MAX_FIELDS", 2)
    with pytest.raises(ValueError):
        drops.union_of_keys(loaded.frames["payments"])
