import json

from wayfold.sources import reports

ROWS = "row_id string, line long, kind string, name string, german string, state string, hint string, why string, candidates string, note string"


def text_of(path):
    return [line for p in sorted(path.iterdir()) if p.name.startswith("part-") for line in p.read_text().splitlines()]


def test_report_is_written_in_order(spark, tmp_path):
    rows = [
        ("b", 5, "water", "Ee", "Au", "ambiguous", "Wyk", "2 plausible | candidates", "way/1:Au", ""), ("a", 3, "settlement", "Naibel", None, "not found", "", "", None, "look\nagain"),
        ("c", 4, "settlement", "X", "Y", "auto", "", "", "", ""), ("d", 9, "water", "Z", "Q", "strange", "", "", "", ""), ("e", 2, "water", "K", "L", "ambiguous", "", "", "node/1", ""),
    ]
    reports.write_report(reports.report_lines(spark.createDataFrame(rows, ROWS)), f"file://{tmp_path}/report")
    assert text_of(tmp_path / "report") == [
        "| kind | auto | by hand | own point | ambiguous | not found | skip | no name | not a place | total |", "|---|" + "---:|" * 9,
        "| water | 0 | 0 | 0 | 2 | 0 | 0 | 0 | 0 | 3 |", "| settlement | 1 | 0 | 0 | 0 | 1 | 0 | 0 | 0 | 2 |", "| **total** | **1** | **0** | **0** | **2** | **1** | **0** | **0** | **0** | **5** |",
        "| id | line | kind | Frisian | German | hint | why | candidates |", "|---|---:|---|---|---|---|---|---|", "| e | 2 | water | K | L |  |  | `node/1` |", "| b | 5 | water | Ee | Au | Wyk | 2 plausible \\| candidates | `way/1:Au` |",
        "| id | line | kind | Frisian | German | note | near misses |", "|---|---:|---|---|---|---|---|", "| a | 3 | settlement | Naibel |  | look again | `` |",
    ]
    empty = reports.report_lines(spark.createDataFrame([], ROWS)).orderBy("section", "place").collect()
    assert len(empty) == 7 and empty[2].text.endswith("| **0** |")


def test_worklist_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"r{k}", None if k % 2 else "x") for k in range(40, 0, -1)], "line long, id string, note string")
    reports.write_worklist(rows, rows.drop("note"), {"bbox": [1, 2], "kind_order": ["ä"]}, f"file://{tmp_path}/work")
    got = [json.loads(x) for x in text_of(tmp_path / "work" / "rows")]
    assert [r["line"] for r in got] == list(range(1, 41)) and got[0] == {"line": 1, "id": "r1", "note": None}
    assert len(text_of(tmp_path / "work" / "places")) == 40
    assert json.loads((tmp_path / "work" / "facts.json").read_text()) == {"bbox": [1, 2], "kind_order": ["ä"]}
    registry = spark.createDataFrame([(3, "frr-x", "hidden", "Öömrang", "n"), (2, "frr-y", "c", None, "")], "line int, tag string, column string, label string, note string")
    assert reports.registry_json(registry) == '[{"tag":"frr-y","label":""},{"tag":"frr-x","label":"Öömrang"}]\n'
