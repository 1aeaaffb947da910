"""Preparation written once and read back."""
from pyspark.sql import functions as F

from shapeloom.operators import contours, tiling
from shapeloom.plans import prepare

GRID = tiling.Grid.even((0, 0, 400, 400), 100, 10)


def test_outline_is_swept_once_and_dealt_by_its_edges(spark, boxes, monkeypatch):
    calls = []
    written = contours.written
    monkeypatch.setattr(contours, "written", lambda df, name: calls.append(name) or written(df, name))
    monkeypatch.setattr(prepare, "EDGES", 4)
    shapes = boxes((0, 0, 130, 90), (100, 50, 390, 300), (5, 305, 395, 395))
    owned, members = prepare.prepare_problem(shapes, GRID, 5, 20, rings=False)
    assert calls == ["outline"]
    for df in (owned, members):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in text and text.count("Exchange") == 1
        assert df.rdd.getNumPartitions() == 3  # 12 edges
    assert owned.filter("core_id < 0").isEmpty()


def test_an_archive_stores_no_derived_columns(spark, boxes, tmp_path):
    direct = prepare.problem(spark, boxes((0, 0, 130, 90), (100, 50, 390, 300)), GRID, 5, 20, rings=False)
    prepare.write_problem(*direct, str(tmp_path / "p"))
    for name, a, b in zip(("segments", "members"), direct, prepare.problem(spark, str(tmp_path / "p"), GRID, 5, 20)):
        assert not set(prepare.DERIVED) & set(spark.read.parquet(f"{tmp_path}/p/{name}").columns)
        cols = sorted(a.columns)
        assert sorted(b.columns) == cols
        assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
        assert [f.dataType for f in a.select(cols).schema] == [f.dataType for f in b.select(cols).schema]


def test_widening_macros_write_edges_and_cut_the_open_ones_only(spark, boxes, monkeypatch):
    columns, cut = [], []
    written, cut_edges = contours.written, prepare.cut_edges
    monkeypatch.setattr(contours, "written", lambda df, name: columns.append(set(df.columns)) or written(df, name))
    monkeypatch.setattr(prepare, "cut_edges", lambda e, *a, **kw: cut.append(e.count()) or cut_edges(e, *a, **kw))
    shapes = boxes((0, 0, 20, 20), (40, 40, 60, 60), (210, 10, 230, 30), (5, 310, 395, 318), (300, 300, 320, 320))
    macros = tiling.Grid.even((0, 0, 400, 400), 100, 30)
    closed = prepare.closed_macros(shapes, macros, GRID, 5, 20, rings=False)
    assert all("seg_ord" not in c for c in columns) and len(columns) == len(cut) - 1 > 1
    assert max(cut[:-1]) < cut[-1]
    cols = ["layer", "core_id", "sx", "sy", "ex", "ey", "nx", "ny"]
    whole, _ = prepare.prepare_problem(shapes, GRID, 5, 20, rings=False)
    assert sorted(map(tuple, closed.select(cols).collect())) == sorted(map(tuple, whole.filter("core_id >= 0").select(cols).collect()))
    assert closed.select("halo").distinct().count() > 1


def test_macros_are_balanced_by_edges(spark, boxes):
    """Edges alike in both are counted, others are compared segment by segment; the balance is that of all segments."""
    shapes = boxes((0, 0, 20, 20), (40, 40, 60, 60), (90, 90, 130, 130), (210, 10, 230, 30), (5, 310, 395, 318), (300, 300, 320, 320), (200, 200, 220, 400))
    macros = tiling.Grid.even((0, 0, 400, 400), 200, 30)
    cols = ["layer", "macro_id", "core_id", "sx", "sy", "ex", "ey", "nx", "ny"]
    whole = prepare.merged_edges(shapes, rings=False)
    edges = prepare.macro_edges(shapes, macros, rings=False)
    other = prepare.macro_edges(boxes((0, 0, 20, 20), (90, 90, 130, 125), (5, 310, 395, 318), (310, 20, 330, 40)), macros, rings=False)
    owned = prepare.macro_of(prepare.seg.owners(prepare.cut_edges(whole, 5, 20), GRID), macros, GRID).filter("core_id >= 0")
    for parts in (edges, edges.unionByName(edges.filter("x0 < 100")), other):
        mine = [tuple(r) for r in prepare.macro_segments(parts, macros, GRID, 5, 20).select(*cols, "open").collect()]
        theirs = [tuple(r) for r in owned.select(*cols).collect()]
        want = {}
        for m in {r[1] for r in mine + theirs}:
            p, w = ([r[:len(cols)] for r in rows if r[1] == m] for rows in (mine, theirs))
            extra = sum(max(p.count(r) - w.count(r), 0) for r in set(p))
            missing = sum(max(w.count(r) - p.count(r), 0) for r in set(w))
            want[m] = (len(w), missing, extra, sum(r[-1] for r in mine if r[1] == m))
        got = prepare.macro_balance(parts, whole, macros, GRID, 5, 20)
        assert {r["macro_id"]: (r["owned"], r["missing"], r["extra"], r["open"]) for r in got.collect()} == want
        # What is dealt before the cut are edges; after it, only sums.
        text = got._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line and "hashpartitioning(layer" in line and "sx" in line for line in text.splitlines())
        assert any("Exchange hashpartitioning(x0" in line for line in text.splitlines()) and "Join" not in text
    assert any(v[1] and v[2] for v in want.values())


def test_all_macros_are_compared_without_dealing_segments(spark):
    """As many rows are shuffled as there are edges, boxes and macros; segments are several times as many."""
    from catalog import QUERIES, tables
    sf_dir = "/root/testdata/sf0.001"
    plan = QUERIES["macros_equal_whole"](spark, sf_dir)._jdf.queryExecution()
    edges = prepare.merged_edges(tables.solid(spark, sf_dir), rings=False)
    segments = prepare.cut_edges(edges, tables.CORNER, tables.MAXIMUM).count()
    rows = plan.toRdd().count()
    assert rows > 0
    text = plan.executedPlan().toString()
    dealt, todo = 0, [plan.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            dealt += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert "Exchange" in text and 0 < dealt < 1.5 * segments, (dealt, segments)
