"""Records in JSON bodies of unsure shape."""

import json

from lakeloom.sources.readers import response_rows


def rows(spark, bodies, paths=("result.rows",), fields=("a", "b"), **more):
    table = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    return sorted((r.n, r.position, *[r[f] for f in fields]) for r in response_rows(table, paths, fields, **more).collect())


def test_a_grid_is_taken_out_of_its_cells_and_markup(spark):
    body = json.dumps({"rows": [{"id": 0, "cell": {"a": "<a href='x'>425</a>", "b": None}}, {"id": 1, "cell": {"a": " 7 "}}, {"id": 2, "cell": 5}, {"id": 3, "cell": {}}]})
    assert rows(spark, [body], ["rows"]) == [(0, 0, "425", ""), (0, 1, "7", "")]
    assert rows(spark, [body], ["rows"], ("id",), wrapper=None) == [(0, i, str(i)) for i in range(4)]


def test_the_first_array_of_objects_is_found_where_the_path_has_none(spark):
    deep = lambda n, leaf: deep(n - 1, {"x": leaf}) if n else leaf
    bodies = [
        json.dumps({"z": [1, 2], "y": {"list": [{"a": "first"}]}, "a": [{"a": "second"}]}),  # document order, not by name
        json.dumps({"text": '[{"a": "no array, a text"}]', "list": [{"a": "found"}]}),
        json.dumps([{"a": "root"}, 3, None, {}, {"a": 1.5}]),
        json.dumps([[], [[{"a": "in arrays"}]]]),
        json.dumps(deep(5, [{"a": "five down"}])),
        json.dumps(deep(6, [{"a": "six down"}])),
        json.dumps({"result": {"rows": "none"}, "more": [{"a": "not at the path"}]}),
    ]
    assert rows(spark, bodies, fields=("a",)) == [(0, 0, "first"), (1, 0, "found"), (2, 0, "root"), (2, 4, "1.5"), (3, 0, "in arrays"), (4, 0, "five down"), (6, 0, "not at the path")]


def test_bodies_without_records_give_no_rows(spark):
    assert rows(spark, [None, "", "  ", "<html>log in</html>", "{", "5", "[]", "{}", '{"result": {"rows": []}, "more": [{"a": "x"}]}']) == []
    assert rows(spark, [json.dumps({"list": [{"a": 1}]})], paths=(), fields=("a",)) == [(0, 0, "1")]


def test_known_places_in_turn(spark):
    places = ["Data.Result", "Data.Datas", "Data"]
    bodies = [json.dumps({"Data": {"Result": [], "Datas": [{"a": "<b>x</b>"}]}}), json.dumps({"Data": [{"a": 1, "b": {"c": [1, 2]}}]}), json.dumps({"Data": {"Result": []}, "Other": {"rows": [{"a": "elsewhere"}]}})]
    assert rows(spark, bodies, places, wrapper=None, tags=False) == [(0, 0, "<b>x</b>", ""), (1, 0, "1", '{"c":[1,2]}'), (2, 0, "elsewhere", "")]


def test_a_long_body_and_columns_of_the_same_name(spark):
    body = json.dumps({"list": [{"a": "x" * 50, "b": i} for i in range(20_000)]})
    table = spark.createDataFrame([("keep", body)], "at string, body string")
    got = response_rows(table, ["rows"], ["b"])
    assert got.columns == ["at", "position", "b"] and got.count() == 20_000
    assert got.agg({"b": "max"}).first()[0] == "9999"
