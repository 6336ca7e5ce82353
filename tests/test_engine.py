"""Builder, parameters, recursion, data-changing statements, transactions and live queries."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.udf import FunctionError, scalar
from lumenframe.operators import dml
from lumenframe.operators.txn import TransactionError, transaction
from lumenframe.plans import recursion
from lumenframe.plans.params import BindingError, Param, QueryDef
from lumenframe.plans.query import CardinalityError, ClauseError, cursor, exactly_one, row, select, zero_or_one
from lumenframe.sources.tables import Namespace, SchemaError, TableDef, create_as, nested, rebuilt, validate
from lumenframe.streaming.live import file_snapshots, first_row

ITEM = TableDef("item", T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType())]), ("id",))


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 30)], ITEM.schema)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_clause_order(items):
    q = select("id").from_(items)
    with pytest.raises(ClauseError):
        q.order_by("id").where(F.col("id") > 1)
    with pytest.raises(ClauseError):
        q.having(F.col("id") > 1)
    with pytest.raises(ClauseError):
        q.offset(1)
    with pytest.raises(ClauseError):
        row(*[F.lit(i) for i in range(7)])
    assert [r.id for r in q.order_by("id").limit(-1).offset(1).df().collect()] == [2, 3]


def test_order_puts_null_first(items):
    assert [r.n for r in select("n").from_(items).order_by("n").df().collect()] == [None, 10, 30]


def test_pairwise_clauses(items):
    """Every pair of source, predicate, grouping and limit builds and runs."""
    for join in (None, "inner", "left"):
        for where in (None, F.col("t0.id") > 1):
            for limit in (None, 1):
                q = select(F.col("t0.id").alias("id")).from_(items)
                q = q if join is None else q.join(items, on=F.col("t0.id") == F.col("t1.id")) if join == "inner" else q.left_join(items, on=F.col("t0.n") == F.col("t1.n"))
                q = q if where is None else q.where(where)
                q = q.order_by("id") if limit else q
                q = q if limit is None else q.limit(limit)
                assert q.df().count() == (1 if limit else 3 if where is None else 2)


def test_namespace():
    names = Namespace()
    names.reserve("T0")
    assert names.next("t") == "t1"
    with pytest.raises(SchemaError):
        names.reserve("t0")


def test_cardinality(items):
    assert exactly_one(items.where("id = 1")).name == "a" and zero_or_one(items.where("id = 9")) is None
    for bad in (items, items.where("id = 9")):
        with pytest.raises(CardinalityError):
            exactly_one(bad)
    assert len(list(cursor(items))) == 3


def test_parameters(spark, items):
    items.createOrReplaceTempView("items")
    q = QueryDef("q", "SELECT id FROM items WHERE id = :id OR n = :n", (Param("id", "bigint"), Param("n", "bigint", True)), cardinality="zeroOrOne")
    assert q.fetch(spark, id=1, n=None).id == 1
    for bad in ({"id": 1}, {"id": 1, "n": 2, "m": 3}, {"id": None, "n": 1}):
        with pytest.raises(BindingError):
            q.df(spark, **bad)
    with pytest.raises(CardinalityError):
        q.fetch(spark, id=1, n=30)


def test_schema_is_checked(items):
    assert validate(items, ITEM.schema) is items
    with pytest.raises(SchemaError):
        validate(items.drop("n"), ITEM.schema)


def test_create(spark, items):
    name = TableDef("made", ITEM.schema).create(spark)
    assert spark.table(name).count() == 0
    assert create_as(items, "made_as").count() == 3
    assert create_as(items.limit(1), "made_as").count() == 3  # exists already


def test_nested_rows(items):
    flat = items.alias("e").select("id", *nested(items, "e", "item"))
    assert rebuilt(flat, "item").select("item.name").count() == 3


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    got = recursion.union(spark.createDataFrame([(1,)], "n long"), lambda f: f.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")))
    assert as_set(got) == {(1,), (2,), (3,), (4,)}
    assert recursion.union_all(spark, "t", ["n"], "SELECT 1", "SELECT n + 1 FROM t WHERE n < 200", "SELECT max(n) FROM t").first()[0] == 200


def test_dml(spark, items):
    new = spark.createDataFrame([(3, "x", 1), (4, "y", 2)], ITEM.schema)
    assert as_set(dml.insert_or(items, new, "ignore", ["id"]).table) == as_set(items) | {(4, "y", 2)}
    assert as_set(dml.replace(items, new, ["id"]).table) == {(1, "a", 10), (2, "b", None), (3, "x", 1), (4, "y", 2)}
    with pytest.raises(dml.ConflictError):
        dml.insert_or(items, new, "abort", ["id"])
    up = dml.upsert_update(items, new, ["id"], {"n": F.col("t.n") + F.col("excluded.n")})
    assert as_set(up.table) == as_set(items.where("id < 3")) | {(3, "c", 31), (4, "y", 2)} and as_set(up.affected) == {(3, "c", 31), (4, "y", 2)}
    assert as_set(dml.update(items, {"n": F.lit(None)}, F.col("n") > 20).table) == {(1, "a", 10), (2, "b", None), (3, "c", None)}
    gone = dml.delete(items, F.col("n") > 20)
    assert as_set(gone.table) == {(1, "a", 10), (2, "b", None)} and as_set(gone.returning("id")) == {(3,)}
    assert dml.update(items, {"n": F.lit(0)}, F.lit(None)).affected.count() == 0


def test_transactions(spark, items, tmp_path):
    tables, seen = {"item": items, "other": items}, []
    with transaction(tables, f"file://{tmp_path}/db", seen.append) as tx:
        gone = tx.apply("item", dml.delete(tx.read("item"), F.lit(True)))
        assert tx.read("item").count() == 0 and gone.count() == 3 and tables["item"].count() == 3
        tx.write("item", items.limit(2))
    assert tables["item"].count() == 2 and seen == [{"item"}] and len(list((tmp_path / "db").iterdir())) == 1
    with pytest.raises(ZeroDivisionError), transaction(tables, f"file://{tmp_path}/db", seen.append) as tx:
        tx.apply("item", dml.delete(tx.read("item")))
        1 / 0
    assert tables["item"].count() == 2 and len(seen) == 1
    with pytest.raises(TransactionError):
        tx.read("item")


def test_repeated_keys_are_refused(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(PySparkException, match="more than once"):
        dml.upsert_update(table, twice, ["k"], {"v": F.col("excluded.v")}).table.collect()
    with pytest.raises(PySparkException, match="more than once"):
        dml.update_from(table, twice, ["k"], {"v": F.col("s.v")}).table.collect()
    assert [tuple(r) for r in dml.insert_or(table.limit(0), twice, "ignore", ["k"]).table.collect()] == [(1, "x")]
    for action in ("abort", "fail", "rollback"):
        with pytest.raises(dml.ConflictError):
            dml.insert_or(table, twice, action, ["k"])


def test_live_first_row(items, tmp_path):
    assert first_row(F.desc(items.columns[0]))(items).count() == 1


def test_file_snapshots(spark, items, tmp_path):
    out = []
    for n in (1, 2):
        items.write.mode("append").parquet(f"{tmp_path}/in")
        file_snapshots(spark, f"{tmp_path}/in", ITEM.schema, lambda df: df.agg(F.count("*").alias("n")), f"{tmp_path}/cp", lambda i, df: out.append(df.first().n))
    assert out == [3, 6]


def test_udf(spark, items):
    @scalar("plus", "bigint", 2)
    def plus(a, b):
        return a + b

    assert items.where("id = 1").select(plus(F.col("id"), F.col("n"))).first()[0] == 11
    with pytest.raises(FunctionError):
        plus(F.col("id"))
    plus.register(spark)
    assert spark.sql("SELECT plus(1, 2)").first()[0] == 3
