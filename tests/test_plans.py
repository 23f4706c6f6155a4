from dataclasses import replace

import pytest

from tablewright.plans import config, decide, schema as schemas, structure
from tablewright.plans.schema import Column, Index, PlanError, TableSchema


def table(*columns, indexes=(), **more):
    return schemas.select_key(TableSchema("t", tuple(columns), tuple(indexes), **more))


ID, V = Column("id", "bigint", nullable=False), Column("v", "varchar(10)", collation="c_bin")
PRIMARY = Index("PRIMARY", ("id",))


def test_key_selection():
    assert table(ID, V, indexes=[PRIMARY]).key_source == "primary"
    two = table(ID, replace(V, nullable=False), indexes=[Index("b", ("id",)), Index("a", ("v",))])
    assert (two.key, two.key_source, two.key_unique) == (("v",), "unique", True)
    assert table(ID, V, indexes=[Index("a", ("v",))]).key == ()
    explicit, warnings = schemas.explicit_key(table(ID, V, indexes=[PRIMARY]), ["ID"])
    assert explicit.key == ("id",) and explicit.key_unique and not warnings
    explicit, warnings = schemas.explicit_key(table(ID, V), ["v"])
    assert not explicit.key_unique and warnings and schemas.nullable_key_warning(explicit)
    with pytest.raises(PlanError):
        schemas.explicit_key(table(ID), ["nope"])


def test_members():
    assert schemas.members("ENUM('a','b''c','d\\'e','x,y')") == ["a", "b'c", "d'e", "x,y"]
    for bad in ("enum('a'", "enum(a)", "enum('a' 'b')", "varchar(3)", "enum('a',)"):
        assert schemas.members(bad) is None


@pytest.mark.parametrize(
    ("a", "b", "fine", "ranges"),
    [
        (ID, ID, True, True),
        (ID, replace(ID, raw_type="varchar(9)"), False, False),
        (V, V, True, True),
        (V, replace(V, collation="c_ci"), False, False),
        (V, replace(V, collation=""), False, False),
        (replace(V, collation=""), replace(V, collation=""), True, True),
        (replace(V, raw_type="geometry"), replace(V, raw_type="geometry"), False, False),
        (replace(V, raw_type="enum('a','b')"), replace(V, raw_type="enum('a','b')"), True, False),
        (replace(V, raw_type="enum('a','b')"), replace(V, raw_type="enum('b','a')"), False, False),
        (replace(V, raw_type="json"), replace(V, raw_type="json"), False, False),
        (replace(V, raw_type="varbinary(4)"), replace(V, raw_type="varbinary(4)"), True, True),
    ],
)
def test_key_order(a, b, fine, ranges):
    ours, theirs = (replace(table(c), key=(c.name,), key_unique=True) for c in (a, b))
    theirs = replace(theirs, key=ours.key, columns=(replace(theirs.columns[0], name=a.name),))
    assert schemas.key_order_compatible(ours, theirs)[0] is fine
    assert schemas.range_addressable(ours, theirs)[0] is ranges


def test_compatibility():
    src = table(ID, Column("d", "decimal(10,2)"), Column("t", "datetime"))
    assert schemas.compatible(src, src) == []
    assert len(schemas.compatible(src, table(ID, Column("d", "decimal(12,3)"), Column("t", "datetime")))) == 1
    assert len(schemas.compatible(src, table(Column("id", "double"), Column("d", "float"), Column("t", "datetime")))) == 2
    swapped = table(ID, Column("d", "decimal(10,2)"), Column("t", "timestamp"))
    with pytest.raises(PlanError):
        schemas.compatible(src, swapped)
    assert len(schemas.compatible(src, swapped, tz_swap=True)) == 1
    with pytest.raises(PlanError):
        schemas.compatible(src, table(ID, Column("d", "decimal(12,3)"), Column("t", "datetime")), strict=True)
    for other in (table(ID), table(V, ID, Column("t", "datetime")), table(ID, Column("d", "text"), Column("t", "datetime"))):
        with pytest.raises(PlanError):
            schemas.compatible(src, other)


def test_ignore_columns():
    a, b = table(ID, V, Column("x", "int")), table(Column("x", "int"), V, ID)
    left, right = schemas.ignore_columns(a, b, ["X"])
    assert left.names == right.names == ["id", "v"]
    assert schemas.ignore_columns(a, b, []) == (a, b)
    for bad in (["id", "v", "x"], ["v"]):
        with pytest.raises(PlanError):
            schemas.ignore_columns(a, table(ID, Column("y", "int")), bad)


FINE = decide.Facts()


@pytest.mark.parametrize(
    ("facts", "where", "mode"),
    [
        (FINE, "", "ROWLEVEL"), (FINE, "x", "ROWLEVEL"), (replace(FINE, dst_keyed=False), "", "FULL"), (replace(FINE, dst_keyed=False), "x", "ERROR"),
        (replace(FINE, src_unique=False), "", "ROWLEVEL"), (replace(FINE, src_unique=False), "x", "ERROR"), (replace(FINE, keys_agree=False, order_compatible=False), "", "FULL"),
        (replace(FINE, keys_agree=False), "x", "ERROR"), (replace(FINE, order_compatible=False, addressable=False), "", "ERROR"), (replace(FINE, addressable=False), "", "FULL"), (replace(FINE, addressable=False), "x", "ERROR"),
    ],
)
def test_decisions(facts, where, mode):
    plan = decide.decide("DIFFERENT", "", facts, where, [3, 1])
    assert plan.mode == mode and plan.argument == bool(where and mode == "ERROR")
    assert plan.chunks == ([1, 3] if mode == "ROWLEVEL" else [])
    assert decide.decide("OK", "", facts, where).mode == "SKIP" and decide.decide("ERROR", "e", facts).error == "e"


def test_scope_never_grows():
    full, rows = decide.Scope(full=True), decide.Scope(rewrites=frozenset("ab"))
    assert decide.within_scope(rows, decide.Scope(rewrites=frozenset("a"))) == ""
    assert decide.within_scope(rows, decide.Scope(rewrites=frozenset("c")))
    assert decide.within_scope(rows, full) and not decide.within_scope(full, rows)
    assert decide.within_scope(decide.Scope(), decide.Scope(deletes_source_empty=True))


def test_batches_and_codes():
    assert [list(r) for r in decide.batches([1] * 5, 2, 100, 1)] == [[0, 1], [2, 3], [4]]
    assert [list(r) for r in decide.batches([60, 60, 10], 10, 100, 1)] == [[0], [1, 2]]
    assert [len(r) for r in decide.batches([1] * 5, 1000, 100, 30_000)] == [2, 2, 1]
    assert list(decide.batches([], 2, 100, 1)) == []
    with pytest.raises(ValueError):
        list(decide.batches([101], 2, 100, 1))
    assert decide.delete_cap(2, 100_000) == 30_000
    assert [decide.exit_code(x) for x in (["OK"], ["OK", "DIFFERENT"], ["DIFFERENT", "ERROR"])] == [0, 1, 2] and decide.exit_code([], True) == 3
    assert decide.sync_tables("abc", "bcd", exclude=["c"]) == (["a", "b"], ["d"])
    assert decide.sync_tables("abc", "bcd", where="x")[1] == [] and decide.sync_tables("abc", "bcd", only="a") == (["a"], [])
    with pytest.raises(ValueError):
        decide.common_tables("ab", "b", only="a")
    assert decide.state_check(decide.AutoIncrement(10, 5))[0] == "AUTO_INCREMENT = 10" and decide.state_check(decide.AutoIncrement(5, 10))[1]


def test_structure():
    src = table(ID, V, Column("n", "int(11)", nullable=False, default="0"), indexes=[PRIMARY, Index("u", ("v",))])
    dst = table(replace(ID, nullable=True), Column("n", "int", nullable=False, default="0", comment="other"), Column("gone", "int"), indexes=[Index("g", ("gone",))])
    found = structure.diff_structure(src, dst)
    assert [(c.kind, (c.column or c.index).name) for c in found] == [("MODIFY_COLUMN", "id"), ("ADD_COLUMN", "v"), ("DROP_COLUMN", "gone"), ("DROP_INDEX", "g"), ("ADD_INDEX", "PRIMARY"), ("ADD_INDEX", "u")]
    ddl = structure.render_ddl("t", found)
    assert ddl == [
        "ALTER TABLE `t` DROP COLUMN `gone`, MODIFY COLUMN `id` bigint NOT NULL, ADD COLUMN `v` varchar(10) COLLATE c_bin NULL AFTER `id`",
        "ALTER TABLE `t` ADD PRIMARY KEY (`id`), ADD UNIQUE KEY `u` (`v`)",
    ]
    assert structure.destructive(ddl[0]) and not structure.destructive(ddl[1])
    assert structure.diff_structure(src, src) == [] and structure.render_ddl("t", []) == []
    generated = table(ID, Column("g", "int", generated="id * 2"))
    assert structure.diff_structure(generated, generated) == []
    with pytest.raises(PlanError):
        structure.diff_structure(generated, table(ID))
    assert "PRIMARY KEY (`id`)" in structure.render_create(src)
    assert structure.without(src, ["V"]).indexes == (PRIMARY,)
    assert TableSchema.from_json(src.to_json()) == src


def test_config():
    made = config.from_yaml("src: ${WHERE}/a\ndst: b\nchunk-size: 20\ntables: [x, y]\nkey: a, b\n", {"WHERE": "/data"})
    assert made.src == "/data/a" and made.tables == ("x", "y") and made.key == ("a", "b") and made.chunk_size == 20
    assert config.overlay(made, {"sample_limit": "0", "drill": True, "parallel": None}).sample_limit == 0
    for bad in ("nope: 1", "a: 1\n---\nb: 2", "chunk-size: 5", "tolerance: .nan", "parallel: 0", "src: ${MISSING}", "drill: 3"):
        with pytest.raises(PlanError):
            config.from_yaml(bad, {})
    assert config.masked("jdbc:mysql://me:secret@host/db") == "jdbc:mysql://me:***@host/db"


def test_addresses():
    full = config.parse_address("me:p@ss:w/ord@db.host:3307/shop")
    assert (full.user, full.password, full.host, full.port, full.database) == ("me", "p@ss:w/ord", "db.host", 3307, "shop")
    assert full.url == "jdbc:mysql://db.host:3307/shop"
    assert config.parse_address("me@h/d").port == 3306 and config.parse_address("me@h/d").password == ""
    assert config.parse_address("me:a@h/d", "b").password == "b"
    assert config.parse_address("me:a@h/d", None, {"PW": "c"}, "PW").password == "c"
    assert config.parse_address("me@[::1]:99/d").host == "::1"
    for bad in ("h/d", "me@h", "me@h:x/d", "me@h/"):
        with pytest.raises(PlanError):
            config.parse_address(bad)


def test_counters():
    assert structure.counter_of("CREATE TABLE `t` (`id` int AUTO_INCREMENT) ENGINE=InnoDB AUTO_INCREMENT=1500 COMMENT='x'") == 1500
    assert structure.counter_of("CREATE TABLE `t` (`id` int COMMENT 'AUTO_INCREMENT=7') COMMENT='AUTO_INCREMENT=9'") is None


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("enum('a','b')", ["a", "b"]), (" SET ( 'x' ,\t'y' ) ", ["x", "y"]), ("enum('it''s','a\\'b','c\\\\d')", ["it's", "a'b", "c\\d"]), ("enum('a\\nb')", ["anb"]),
        ("enum('a,b','')", ["a,b", ""]), ("enum()", None), ("enum(a)", None), ("enum('a' 'b')", None), ("enum('a", None), ("varchar(3)", None), ("enum('a\\')", None),
    ],
)
def test_member_lists(raw, expected):
    assert schemas.members(raw) == expected
