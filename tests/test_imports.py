import json

from sediment.plans.stores import RULES
from sediment.sources import imports


def write(path, rows):
    path.mkdir(parents=True)
    (path / "part.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")


def test_every_line_is_accepted_or_refused_with_its_reason(spark, tmp_path):
    base = {"kind": "export", "version": 1}
    write(tmp_path / "conversations", [base | {"id": 1, "title": "é"}, base | {"id": 2, "title": None}, base | {"id": 3, "version": 2}, base | {"id": 4, "kind": "x"}, base | {"title": "no id"}, "[1]", "null", "{", base | {"id": "text"}, {"id": 5, "kind": "export"}, base | {"id": 6, "version": "1"}])
    own = base | {"conversation_id": 1, "created": "2024-05-01T10:00:00Z"}
    write(tmp_path / "messages", [
        own | {"id": 1}, own | {"id": 2, "created": 1714557600000, "parent_id": 1}, own | {"id": 3, "parent_id": 99}, own | {"id": 4, "conversation_id": 3}, own | {"id": 5, "conversation_id": None},
        own | {"id": 6, "created": "soon"}, own | {"id": 7}, own | {"id": 7}, own | {"id": 7, "extra": [1]}, own | {"id": 8, "created": None},
    ])
    good, bad = imports.read_import(spark, f"file://{tmp_path}", RULES, 1)
    assert sorted((r["id"], r["title"]) for r in good["conversations"].collect()) == [(1, "é"), (2, None)]
    messages = {r["id"]: r for r in good["messages"].collect()}
    assert sorted(messages) == [1, 2, 3, 7, 8] and messages[1]["created"] == messages[2]["created"] and messages[8]["created"] is None
    assert messages[3]["parent_id"] is None and messages[2]["parent_id"] == 1  # there is no row 99
    reasons = sorted((r["part"], r["reason"]) for r in bad.collect())
    assert reasons == sorted([("conversations", x) for x in ("bad_version", "wrong_kind", "missing", "unreadable", "unreadable", "unreadable", "unreadable", "bad_version", "unreadable")] + [("messages", x) for x in ("orphan", "missing", "bad_date", "repeated", "repeated")])
    assert sorted(r["line"] for r in bad.where("reason = 'unreadable'").collect())[:1] == ["[1]"]


def test_missing_and_empty_tables(spark, tmp_path):
    write(tmp_path / "messages", [{"kind": "export", "version": 1, "id": 1, "conversation_id": 1}])
    good, bad = imports.read_import(spark, f"file://{tmp_path}", RULES, 1)
    assert list(good) == ["messages"] and good["messages"].collect() == [] and [r["reason"] for r in bad.collect()] == ["orphan"]
