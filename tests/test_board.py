"""The board's rows, pages and lines on small tables with stated results."""

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import board, names

STOCK = "source string, item_ref string, raw_name string, quantity long, warehouse string, lot string"
MEMBERS = "unit_id int, source string, item_ref string, factor int, confirmed boolean"
L, R = "erp", "wms"


@pytest.fixture
def rows(spark):
    def make(stock, members=(), marks=(), units=(), needle=""):
        items = board.keyed(board.overlay(spark.createDataFrame([(*s, "1", "A") for s in stock], STOCK), spark.createDataFrame(list(members), MEMBERS), spark.createDataFrame(list(marks), "source string, item_ref string, reason string")))
        return items, board.board_rows(items, spark.createDataFrame(list(units), "unit_id int, unit_name string"), L, needle)

    return make


def by_key(frame, *columns):
    return {r.key: tuple(r[c] for c in columns) for r in frame.collect()}


def test_kinds_and_what_goes_first(rows):
    """A unit goes before a mark, a mark before the name; names meet after the rules; a blank name is its reference."""
    stock = [(L, "a1", "Tent (new)", 5), (R, "b1", "tent", 3), (L, "a2", "Lamp", 1), (R, "b2", "Lamp", 1), (L, "a3", "Mat", 2), (R, "b3", "", 4), (L, "b3", None, 6), (L, "a4", "Cup", 7), (R, "b4", "Pan", 8)]
    members = [(1, L, "a2", 1, True), (1, R, "b2", 12, False), (2, R, "gone", 3, True)]
    items, found = rows(stock, members, [(L, "a3", "NO_MATE"), (L, "a2", "NO_MATE"), (L, "nowhere", "NO_MATE")], [(1, "Lamps")])
    assert by_key(found, "kind", "name", "left_items", "right_items", "left_total", "right_total", "confirmed", "missing") == {
        "N:tent": ("PAIRED", "Tent (new)", 1, 1, 5, 3, False, False),
        "U:1": ("LINKED", "Lamps", 1, 1, 1, 12, False, False),
        "U:2": ("LINKED", board.NAMELESS, 0, 1, 0, 0, True, True),
        "X:erp|a3": ("SET_ASIDE", "Mat", 1, 0, 2, 0, False, False),
        "N:b3": ("PAIRED", "b3", 1, 1, 6, 4, False, False),
        "N:cup": ("LEFT_ONLY", "Cup", 1, 0, 7, 0, False, False),
        "N:pan": ("RIGHT_ONLY", "Pan", 0, 1, 0, 8, False, False),
    }
    assert items.filter("item_ref = 'nowhere'").count() == 0


def test_a_name_that_rules_empty_is_a_row_of_its_own(rows):
    _, found = rows([(L, "a", "(x)", 1), (R, "b", "(y)", 1)])
    assert by_key(found, "kind") == {"N:erp|a": ("LEFT_ONLY",), "N:wms|b": ("RIGHT_ONLY",)}


def test_rules_of_one_source(spark):
    stock = spark.createDataFrame([(L, "a", "ERP-tent", 1, "1", "A"), (R, "b", "tent", 1, "1", "A"), (R, "c", "ERP-tent", 1, "1", "A")], STOCK)
    none = spark.createDataFrame([], MEMBERS), spark.createDataFrame([], "source string, item_ref string, reason string")
    keys = {r.item_ref: r.key for r in board.keyed(board.overlay(stock, *none), {L: [("^ERP-", "")]}).collect()}
    assert keys == {"a": "N:tent", "b": "N:tent", "c": "N:erp-tent"}


def test_pages_tabs_and_search(rows):
    stock = [(L, f"r{i:03}", f"name {i:03}", 1) for i in range(60)] + [(R, "x", "name 007", 1), (R, "Zed", "other", 1)]
    _, found = rows(stock, marks=[(L, "r001", "NO_MATE")])
    names_of = lambda *a: [r.name for r in board.page(found, *a).collect()]
    assert names_of("TODO", 0) == [f"name {i:03}" for i in range(26) if i != 1]
    assert names_of("TODO", -3) == names_of(None, 0) == names_of("NONSENSE", 0) == names_of("TODO", 0)
    assert len(names_of("TODO", 2)) == 10 and names_of("TODO", 3) == names_of("TODO", 10**9) == []
    assert names_of("PAIRED") == ["name 007"] and names_of("SET_ASIDE") == ["name 001"] and names_of("LINKED") == []
    assert len(names_of("ONE_SIDED", 1)) == 25 and len(names_of("ALL", 2)) == 11
    _, hit = rows(stock, needle=" ZED ")
    assert [r.name for r in hit.collect()] == ["other"]
    _, hit = rows(stock, needle="R03")
    assert len(hit.collect()) == 10


def test_items_of_a_page(rows):
    """A name of very many items is one row of the board; its items come by side, if asked for only the first ones."""
    stock = [(L, f"a{i:04}", "same", 1) for i in range(500)] + [(R, "b", "same", 2), (R, "c", "else", 1)]
    items, found = rows(stock)
    shown = board.page(found, "PAIRED")
    assert [(r.left_items, r.right_items, r.left_total, r["diff"], r.percent) for r in shown.collect()] == [(500, 1, 500, 498, 99.6)]
    assert board.items_of(items, shown, L).count() == 501
    assert [(r.side, r.item_ref) for r in board.items_of(items, shown, L, 2).orderBy("side", "item_ref").collect()] == [("left", "a0000"), ("left", "a0001"), ("right", "b")]


def made_parts(spark, axis=None):
    stock = [(L, "a", "Big tent", 5, "1", "x"), (L, "a", "Big tent", 2, "9", "x"), (L, "b", "Lamp", 3, "9", "y"), (L, "c", "Mat", 1, "1", " "), (R, "p", "big  TENT", 4, "1", "y"), (R, "q", "Lamps", 1, "1", "x"), (R, "r", "Cup", 1, "1", "")]
    members = [(1, s, i, f, True) for s, i, f in ((L, "a", 2), (L, "b", 1), (L, "c", 1), (R, "p", 1), (R, "q", 1), (R, "r", 1), (R, "gone", 1))] + [(1, L, "z", 1, False)]
    return board.parts(spark.createDataFrame(stock, STOCK), spark.createDataFrame(members, MEMBERS), F.col("warehouse") == "1", axis)


def shown(frame):
    return [(r.left_item, r.right_item, r.label, r.left_quantity, r.right_quantity) for r in frame.orderBy("line").collect()]


def test_lines_by_name_field_and_none(spark):
    """`b` is outside the filter: its line and its name stay, without a quantity. Pairs come first, then the rest by label."""
    by_name = shown(board.lines(made_parts(spark), "NAME", L, R))
    assert by_name[0] == ("a", "p", "Big tent", 10, 4) and ("b", "q", "Lamp", 0, 1) in by_name
    assert len(by_name) == 4 and {x[1] for x in by_name} == {"p", "q", "r", "gone"}
    assert shown(board.lines(made_parts(spark, "lot"), "FIELD", L, R)) == [("a", "q", "Big tent", 10, 1), (None, "r", "Cup", 0, 1), ("b", None, "Lamp", 0, 0), ("c", None, "Mat", 1, 0), (None, "p", "big  TENT", 0, 4), (None, "gone", "gone", 0, 0)]
    assert [x[:3] for x in shown(board.lines(made_parts(spark), "NONE", L, R))] == [("a", None, "Big tent"), (None, "r", "Cup"), ("b", None, "Lamp"), (None, "q", "Lamps"), ("c", None, "Mat"), (None, "p", "big  TENT"), (None, "gone", "gone")]
    with pytest.raises(ValueError):
        board.lines(made_parts(spark), "COLOUR", L, R)


def test_a_missing_axis_counts_what_is_in_stock(spark):
    get = lambda parts: [tuple(r)[1:] for r in board.axis_missing(parts, L, R).collect()]
    assert get(made_parts(spark, "lot")) == [(False, False)]
    blank = made_parts(spark, "lot").withColumn("axis", F.when(F.col("item_ref") == "b", "y").otherwise(" "))
    assert get(blank) == [(True, True)]  # b is out of stock, so its value proves nothing
    assert get(made_parts(spark, "lot").withColumn("quantity", F.lit(None).cast("long"))) == [(False, False)]


def test_lines_by_name_take_the_likest_first(spark, sf_dir):
    """The query over whole tables against plain Python."""
    got = {(r.unit_id, r.left_item, r.right_item) for r in board.QUERIES["breakdown_lines_name"](spark, sf_dir).filter("paired").collect()}
    units = {}
    for r in board._parts(spark, sf_dir).collect():
        units.setdefault(r.unit_id, {L: [], R: []})[r.source].append((r.item_ref, "".join(r.name.split()).lower()))
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    wanted = set()
    for unit, sides in units.items():
        scored = sorted(((-(1.0 if n == m else 2 * len(grams(n) & grams(m)) / max(1, len(grams(n)) + len(grams(m)))), a, b) for a, n in sides[L] for b, m in sides[R]))
        left, right = set(), set()
        for _, a, b in scored:
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                wanted.add((unit, a, b))
    assert got == wanted


@pytest.mark.parametrize("small", [0, 20_000])
def test_pairs_at_once_and_in_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(names, "SMALL_UNIT", small)
    rng = random.Random(4)
    scored = [(u, f"l{i}", f"r{j}", rng.choice([0.0, 0.5, 0.5, 1.0])) for u in (1, 2, None) for i in range(7) for j in range(6)]
    got = {tuple(r)[:3] for r in names.greedy_pairs(spark.createDataFrame(scored, "unit_id int, left_name string, right_name string, score double")).collect()}
    wanted, used = set(), set()
    for u, a, b, s in sorted(scored, key=lambda r: (-r[3], r[1], r[2])):
        if (u, a) not in used and (u, b) not in used:
            used |= {(u, a), (u, b)}
            wanted.add((u, a, b))
    assert got == wanted
