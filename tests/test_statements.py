import pytest

from brindle.operators.dml import ConstraintError
from brindle.plans.statements import execute
from brindle.sources.catalog import Database


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def db(spark):
    db = Database(spark)
    execute(db, """
        create table if not exists st_dept (id integer primary key, name text not null unique);
        create table st_emp (id integer primary key autoincrement, name varchar(20) collate nocase, dept_id int references st_dept(id) on delete cascade,
            pay real default 10.0 check (pay >= 0), twice real generated always as (pay * 2) stored);
        create table st_badge (id integer, emp_id integer, foreign key (emp_id) references st_emp (id) on delete cascade);
        insert into st_dept values (1, 'Engineering'), (2, 'Marketing');
        insert into st_emp (name, dept_id) values ('Ann', 1), ('Bo', 1), ('Cy; "x"', 2);
        insert into st_badge values (7, 1), (8, 3);
    """)
    return db


def test_insert_numbers_defaults_generated(db):
    assert rows(execute(db, "select id, name, pay, twice from st_emp")) == [(1, "Ann", 10.0, 20.0), (2, "Bo", 10.0, 20.0), (3, 'Cy; "x"', 10.0, 20.0)]
    assert rows(execute(db, "insert into st_emp (name, pay) select name, 7 / 2 from st_dept where id = ? returning id, name, pay", [2])) == [(4, "Marketing", 3.0)]
    assert rows(execute(db, "insert into st_emp default values returning id, pay")) == [(5, 10.0)]
    with pytest.raises(ValueError, match="3 values for 2 columns"):
        execute(db, "insert into st_emp (id, name) values (1, 'a', 2)")


def test_conflicts_on_every_key(db):
    assert rows(execute(db, "insert or ignore into st_dept values (1, 'x'), (3, 'Marketing'), (4, 'New'), (4, 'Newer') returning *")) == [(4, "New")]
    execute(db, "replace into st_dept values (9, 'Marketing'), (1, 'R1'), (1, 'R2')")
    assert rows(db.tables["st_dept"]) == [(1, "R2"), (4, "New"), (9, "Marketing")]
    got = execute(db, "insert into st_dept values (4, 'on conflict'), (5, 'Five') on conflict (id) do update set name = name || '+' || excluded.name returning name")
    assert rows(got) == [("Five",), ("New+on conflict",)]
    execute(db, "insert into st_dept values (4, 'gone'), (6, 'Six') on conflict do nothing")
    assert [r[0] for r in rows(db.tables["st_dept"])] == [1, 4, 5, 6, 9]
    with pytest.raises(ConstraintError, match="UNIQUE"):
        execute(db, "insert into st_dept values (77, 'Six')")
    with pytest.raises(ValueError, match="ON CONFLICT"):
        execute(db, "insert into st_emp (id) values (1) on conflict (pay) do nothing")


def test_keyless_table(db):
    execute(db, "create table st_log (what text); insert or ignore into st_log values ('a'), ('a'); insert or replace into st_log values ('a')")
    assert rows(db.tables["st_log"]) == [("a",)] * 3


def test_update_delete(db):
    assert rows(execute(db, "update st_emp set pay = pay + :more where dept_id = 1 returning id, twice", {"more": 1})) == [(1, 22.0), (2, 22.0)]
    assert rows(execute(db, "select id, twice from st_emp where id < 3")) == [(1, 22.0), (2, 22.0)]
    assert rows(execute(db, "delete from st_dept where name like 'ENG%' returning id")) == [(1,)]
    assert rows(db.tables["st_badge"]) == [(8, 3)]  # two levels down
    assert rows(execute(db, "delete from st_badge")) == [(1,)]


def test_refused_delete_leaves_all(db):
    execute(db, "create table st_lock (emp_id integer references st_emp(id) on delete restrict); insert into st_lock values (2)")
    with pytest.raises(ConstraintError):
        execute(db, "delete from st_dept")
    assert [db.tables[t].count() for t in ("st_dept", "st_emp", "st_badge")] == [2, 3, 2]


def test_transactions(db):
    execute(db, "begin; delete from st_badge; savepoint a; alter table st_dept add column floor integer default 2; insert into st_badge values (1, 1); rollback to a")
    assert db.tables["st_badge"].count() == 0 and db.tables["st_dept"].columns == ["id", "name"]
    execute(db, "release a; rollback")
    assert db.tables["st_badge"].count() == 2
    for bad in ("commit", "rollback", "release zz"):
        with pytest.raises(ValueError):
            execute(db, bad)


def test_ddl_and_pragma(db):
    execute(db, "create unique index st_i on st_emp (name) where pay > 5; create view st_v as select id, pay / 0 as n from st_emp; alter table st_dept rename column name to title")
    assert rows(execute(db, "pragma table_info(st_dept)").select("name", "type", "pk")) == [("id", "INTEGER", 1), ("title", "TEXT", 0)]
    assert rows(execute(db, "pragma index_list(st_emp)").select("name", "unique", "partial")) == [("st_i", 1, 1)]
    assert rows(execute(db, "select * from st_v where id = 1")) == [(1, None)]
    execute(db, "drop view st_v; drop index st_i; drop table if exists st_none; create table st_copy as select * from st_dept; drop table st_copy")
    with pytest.raises(ValueError, match="no such table"):
        execute(db, "drop table st_copy")
    with pytest.raises(ValueError):
        execute(db, "update st_dept set title = 'x' from st_emp")
