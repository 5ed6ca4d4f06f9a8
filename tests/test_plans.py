"""Plan shapes and the driver contract on sf0.001."""

import __spark_entry__ as E

SF001 = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unsent_plan_has_anti_join_and_top_k(spark):
    p = _plan(E.queries()["unsent_news"](spark, SF001))
    assert "TakeOrderedAndProject" in p
    assert "LeftAnti" in p
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p


def test_per_chat_plan_has_no_cartesian(spark):
    p = _plan(E.queries()["unsent_per_chat"](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_pushdown_reaches_scan(spark):
    from wirefold.sources import tables as TB
    sent = TB.sent_lineitem(spark, SF001).filter("sent_to_chat_id = 'N'")
    p = _plan(sent)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,N)]" in p


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"chat_id", "rank", "news_id", "message"}
    assert df.count() > 0


def _state_side_exchanges(df, table):
    """Exchanges between the scan of ``table`` and the join above it."""
    lines = _plan(df).split("Initial Plan")[-1].splitlines()
    assert any("Scan parquet" in line and table in line for line in lines)
    found = []
    for at, line in enumerate(lines):
        if "Scan parquet" in line and table in line:
            depth = len(line) - len(line.lstrip(" :+-*("))
            for above in reversed(lines[:at]):
                d = len(above) - len(above.lstrip(" :+-*("))
                if d < depth:
                    depth = d
                    if "Join" in above:
                        break
                    if "Exchange" in above:
                        found.append(above.strip())
    return found


def test_bucketed_state_is_not_shuffled(spark, tmp_path):
    from pyspark.sql import functions as F

    from wirefold.operators import select as SEL
    from wirefold.operators import state as ST
    from wirefold.sources import bucketed as BU
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        news = spark.range(5000).selectExpr("id", "id % 7 AS source_id", "timestamp_seconds(id) AS fetched_at", "concat('u', id) AS url")
        sent = spark.range(0, 5000, 2).selectExpr("id AS news_id", "'c' AS sent_to_chat_id")
        by_url = BU.save_bucketed(news, "plan_news_by_url", str(tmp_path / "a"), ["url"], 8)
        by_id = BU.save_bucketed(news, "plan_news_by_id", str(tmp_path / "b"), ["id"], 8)
        log = BU.save_bucketed(sent, "plan_sent_by_news", str(tmp_path / "c"), ["news_id"], 8)
        changes = spark.range(4990, 5010).selectExpr("concat('u', id) AS url", "id AS o")
        fresh = ST.insert_or_ignore(by_url.select("url"), changes, ["url"], ["o"])
        assert _state_side_exchanges(fresh, "plan_news_by_url") == []
        assert sorted(r["url"] for r in fresh.collect()) == [f"u{i}" for i in range(5000, 5010)]
        top = SEL.unsent(by_id.select("id", "fetched_at"), log, "c").orderBy(F.desc("id")).limit(3)
        assert _state_side_exchanges(top, "plan_news_by_id") == [] == _state_side_exchanges(top, "plan_sent_by_news")
        assert [r["id"] for r in top.collect()] == [4999, 4997, 4995]
        plain = ST.insert_or_ignore(news.select("url"), changes, ["url"], ["o"])
        assert "Exchange hashpartitioning(url" in _plan(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("plan_news_by_url", "plan_news_by_id", "plan_sent_by_news"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
