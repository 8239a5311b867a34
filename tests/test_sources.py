import json

from pyspark.sql import functions as F

from millrace.sources import config, kv, requests


def test_key_value_table(spark, tmp_path):
    t = kv.KeyValueTable(spark, str(tmp_path / "kv"))
    rows = lambda *r: spark.createDataFrame(r, "key string, value string")
    t.save(rows(("a/1", "x"), ("a/2", "y"), ("b", "z")), 1)
    t.save(rows(("a/1", "x2")), 2)
    t.delete(rows(("b", "")), 3)
    t.save(rows(("gone", "v")), 4, ttl_s=-5)
    assert {(r.key, r.value) for r in t.load().collect()} == {("a/1", "x2"), ("a/2", "y")}
    assert [r.key for r in t.list_keys("a/").collect()] == ["a/1", "a/2"]
    assert t.exists(rows(("b", ""), ("a/2", ""))).count() == 1
    t.compact(str(tmp_path / "compact"))
    assert kv.KeyValueTable(spark, str(tmp_path / "compact")).load().count() == 2


def test_json_folder(spark, tmp_path):
    (tmp_path / "k1.json").write_text('{"a": 1}')
    assert [(r.key, r.value) for r in kv.read_json_store(spark, str(tmp_path)).collect()] == [("k1", '{"a": 1}')]


def test_hibernate_and_wake(spark, tmp_path):
    row = spark.createDataFrame([("o1", "custom", '{"x":1}', '{"result":99}', "learning", None)], "id string, intent string, input string, state string, lifecycle string, parent_id string")
    ids = requests.hibernate(row, str(tmp_path / "hib"))
    back = requests.wake(spark, str(tmp_path / "hib"), ids.select("hib_id")).first()
    assert (back.id, back.state) == ("o1", '{"result":99}')
    assert requests.list_hibernated(spark, str(tmp_path / "hib")).count() == 1


def test_probe_never_raises(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("down")
        return 200, "fine"

    got = {r.url: (r.ok, r.status_code, r.body) for r in requests.probe(spark.createDataFrame([("good",), ("bad",)], "url string"), fetch).collect()}
    assert got == {"good": (True, 200, "fine"), "bad": (False, 0, "down")}


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"a": {"b": "${X}-${Y:d}"}, "l": ["${X}"]}))
    s = config.Settings.load(str(p), {"X": "1"})
    assert s.get("a.b") == "1-d" and s.get("l") == ["1"] and s.get("a.c", 7) == 7
    s.set("n.m", 2)
    assert s.get("n.m") == 2
    assert F is not None
