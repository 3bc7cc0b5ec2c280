import pytest
from pyspark.sql import functions as F

from brindle.operators import dml
from brindle.operators.dml import ConstraintError, Definition, Rule
from brindle.sources.catalog import Database, Trigger


@pytest.fixture()
def db(spark):
    db = Database(spark)
    db.create_table("dept", Definition({"id": Rule("INTEGER"), "name": Rule("TEXT", not_null=True)}, ["id"]))
    db.create_table("emp", Definition({"id": Rule("INTEGER"), "name": Rule("TEXT"), "dept_id": Rule("INTEGER"), "pay": Rule("REAL", default="10.0", check="pay >= 0"), "double_pay": Rule("REAL", generated="pay * 2")}, ["id"], foreign=[(["dept_id"], "dept", ["id"], "CASCADE")]))
    db.insert("dept", spark.createDataFrame([(1, "Engineering"), (2, "Marketing")], "id long, name string"))
    db.insert("emp", spark.createDataFrame([(1, "Alice", 1), (2, "Bob", 1), (3, "Carol", 2), (4, "Dave", None)], "id long, name string, dept_id long"))
    return db


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_defaults_and_generated(db, spark):
    assert rows(db.tables["emp"].select("id", "pay", "double_pay"))[0] == (1, 10.0, 20.0)
    assert db.changes == 4 and db.total_changes == 6
    with pytest.raises(ConstraintError, match="generated"):
        db.insert("emp", spark.createDataFrame([(9, 1.0)], "id long, double_pay double"))


def test_constraints_leave_the_table(db, spark):
    for bad, schema, error in (([(1, "x")], "id long, name string", "UNIQUE"), ([(5, "x", 9)], "id long, name string, dept_id long", "FOREIGN"), ([(5, -1.0)], "id long, pay double", "CHECK")):
        with pytest.raises(ConstraintError, match=error):
            db.insert("emp", spark.createDataFrame(bad, schema))
    with pytest.raises(ConstraintError, match="NOT NULL"):
        db.insert("dept", spark.createDataFrame([(7,)], "id long"))
    assert db.tables["emp"].count() == 4


def test_conflicts(db, spark):
    new = spark.createDataFrame([(1, "R&D"), (3, "Sales")], "id long, name string")
    assert rows(db.insert("dept", new, "IGNORE")) == [(3, "Sales")]
    db.insert("dept", new, "REPLACE")
    assert rows(db.tables["dept"]) == [(1, "R&D"), (2, "Marketing"), (3, "Sales")]
    db.upsert("dept", spark.createDataFrame([(2, "!"), (4, "New")], "id long, name string"), {"name": "old.name || excluded.name"})
    assert rows(db.tables["dept"])[1::2] == [(2, "Marketing!"), (4, "New")]


def test_update_delete_cascade(db):
    assert rows(db.update("emp", {"pay": "pay + 1"}, "dept_id = 1").select("id", "pay")) == [(1, 11.0), (2, 11.0)]
    db.delete("dept", "id = 1")
    assert [r[0] for r in rows(db.tables["emp"].select("id"))] == [3, 4]


def test_triggers_and_rollback(db, spark):
    db.create_table("log", Definition({"what": Rule("TEXT")}))
    db.triggers["t"] = Trigger("dept", "AFTER", "INSERT", lambda base, delta: base.insert("log", delta.select(F.col("name").alias("what"))), condition="id > 2")
    before = db.snapshot()
    db.insert("dept", spark.createDataFrame([(3, "Sales")], "id long, name string"))
    assert rows(spark.table("log")) == [("Sales",)]
    db.rollback(before)
    assert db.tables["dept"].count() == 2 and spark.table("log").count() == 0


def test_alter_and_introspection(db, spark, tmp_path):
    db.create_index("by_name", "dept", ["name"], unique=True)
    with pytest.raises(ConstraintError):
        db.insert("dept", spark.createDataFrame([(9, "Marketing")], "id long, name string"))
    db.add_column("dept", "floor", Rule("INTEGER", default="1"))
    db.rename_column("dept", "floor", "level")
    assert rows(db.table_info("dept").select("name", "pk")) == [("id", 1), ("level", 0), ("name", 0)]
    db.drop_column("dept", "level")
    assert rows(db.index_list("dept").select("name", "unique")) == [("by_name", 1)]
    assert rows(db.foreign_key_list("emp").select("from", "to", "on_delete")) == [("dept_id", "id", "CASCADE")]
    assert ("dept", "by_name", "2 1") in rows(db.analyze())
    other = Database(spark, "aux")
    other.create_table_as("t", spark.range(3))
    db.attach("aux", other)
    assert spark.table("aux__t").count() == 3 and rows(db.database_list()) == [(0, "main"), (1, "aux")]
    db.detach("aux")
    db.vacuum_into(str(tmp_path))
    again = Database(spark)
    again.open_folder(str(tmp_path), ["dept"])
    assert again.tables["dept"].count() == 2
    assert "Scan" in db.explain("select * from dept") or "Relation" in db.explain("select * from dept")
    db.rename_table("dept", "unit")
    db.drop_table("unit")
    assert "unit" not in db.tables


def test_set_default(spark):
    child = spark.createDataFrame([(1, 1), (2, 2)], "id int, p int")
    gone = spark.createDataFrame([(1,)], "k int")
    assert rows(dml.on_delete(child, ["p"], gone, ["k"], "SET DEFAULT", {"p": "2"})) == [(1, 2), (2, 2)]
    with pytest.raises(ConstraintError):
        dml.on_delete(child, ["p"], gone, ["k"], "RESTRICT")


def test_stream_windows(spark, tmp_path):
    from brindle.streaming import windows as w

    data = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:55:00", "a", 2.0), ("2024-01-01 01:05:00", "b", 3.0)], "ts string, k string, v double").selectExpr("cast(ts as timestamp) ts", "k", "v")
    data.write.parquet(str(tmp_path / "in"))
    stream = w.tumbling(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", ["k"], "v", late="10 minutes")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    run.processAllAvailable()
    run.stop()
    assert rows(spark.table("tumbled").select("k", "n", "total")) == [("a", 2, 3.0), ("b", 1, 3.0)]
