import random
import re
import time

from conftest import rows
from texts import DB_REPO, DJANGO, NEGATIVE_REPO, PRISMA, SQL, SQLALCHEMY

from fleetfacts.operators import dbschema as D

COLUMN = ["table_name", "name", "data_type", "primary_key", "foreign_key", "nullable", "unique", "default"]
RELATION = ["from_table", "from_column", "to_table", "to_column", "relationship_type", "inferred"]


def parsed(make_files, path, text):
    models = D.schema_models(make_files(("r", path, text)))
    return (
        rows(D.schema_columns(D.schema_tables(models)), *COLUMN),
        rows(D.schema_relationships(models), *RELATION),
    )


def test_sql(make_files):
    columns, relations = parsed(make_files, "schema.sql", SQL)
    assert columns == [
        ("notes", "body", "TEXT", False, None, True, False, None),
        ("notes", "id", "INTEGER", True, None, False, False, None),
        ("notes", "other", "INTEGER", False, None, True, False, None),
        ("notes", "user_id", "INTEGER", False, "users.id", False, False, None),
        ("users", "id", "INTEGER", True, None, False, False, None),
        ("users", "login", "VARCHAR", False, None, False, True, None),
        ("users", "note", "TEXT", False, None, True, False, None),
        ("users", "price", "DECIMAL", False, None, True, False, "0"),
    ]
    assert relations == [
        ("notes", "other", "users", "id", "one_to_many", False),
        ("notes", "user_id", "users", "id", "one_to_many", False),
    ]


def test_sqlalchemy(make_files):
    columns, relations = parsed(make_files, "m.py", SQLALCHEMY)
    assert columns == [
        ("tag", "id", "INTEGER", True, None, False, False, None),
        ("tag", "user_id", "INTEGER", False, "users.id", True, False, None),
        ("users", "active", "BOOLEAN", False, None, False, False, "True"),
        ("users", "id", "INTEGER", True, None, False, False, None),
        ("users", "late", "BOOLEAN", False, None, False, False, None),
        ("users", "login", "STRING", False, None, False, True, None),
    ]
    assert relations == [
        ("tag", "user_id", "users", "id", "one_to_many", False),
        ("users", "notes", "note", None, "unknown", True),
    ]


def test_django(make_files):
    columns, relations = parsed(make_files, "m.py", DJANGO)
    assert columns == [
        ("article", "category", "INTEGER", False, "category", False, False, None),
        ("article", "cover", "INTEGER", False, "image", True, False, None),
        ("article", "id", "BIGINT", True, None, False, False, None),
        ("article", "place", "POINTFIELD", False, None, False, False, None),
        ("categories", "name", "VARCHAR", False, None, False, True, None),
        ("categories", "parent", "INTEGER", False, None, True, False, None),
    ]
    assert relations == [
        ("article", "category", "category", None, "one_to_many", False),
        ("article", "cover", "image", None, "one_to_one", False),
        ("article", "tags", "tag", None, "many_to_many", False),
    ]


def test_prisma(make_files):
    columns, relations = parsed(make_files, "prisma/schema.prisma", PRISMA)
    assert columns == [
        ("category", "id", "INTEGER", True, None, False, False, None),
        ("product", "categoryId", "INTEGER", False, None, False, False, None),
        ("product", "created", "DATETIME", False, None, False, False, "now("),
        ("product", "id", "INTEGER", True, None, False, False, "autoincrement("),
        ("product", "name", "VARCHAR", False, None, False, True, None),
        ("product", "text", "VARCHAR", False, None, True, False, None),
    ]
    assert relations == [("product", "categoryId", "category", "id", "one_to_many", False)]


def test_repository_keeps_best_table_once(make_files, spark):
    files = make_files(*DB_REPO, *NEGATIVE_REPO)
    models = D.schema_models(files)
    tables = D.schema_tables(models)
    assert rows(tables, "name", "source_type", "confidence") == [
        ("article", "django", 0.9),
        ("categories", "django", 0.9),
        ("category", "prisma", 1.0),
        ("notes", "sql", 1.0),
        ("product", "prisma", 1.0),
        ("tag", "sqlalchemy", 0.9),
        ("users", "sql", 1.0),
    ]
    repos = spark.createDataFrame([("db",), ("none",)], "repo_id string")
    overview = D.schema_overview(repos, tables, D.schema_relationships(models))
    assert rows(overview, "repo_id", "detected", "table_count", "relationship_count") == [
        ("db", True, 7, 8),
        ("none", False, 0, 0),
    ]


def test_wide_table_and_deep_nesting(make_files):
    body = ",\n".join(f"c{i} DECIMAL(10, 2) CHECK ((c{i} > (0)))" for i in range(20000))
    files = make_files(("r", "big.sql", f"CREATE TABLE big (\n{body}\n);"))
    tables = D.schema_tables(D.schema_models(files))
    assert tables.selectExpr("size(columns)").first()[0] == 20000


def test_long_class_body(make_files):
    fields = "\n".join(f"    f{i} = Column(Integer)\n# note" for i in range(20000))
    text = f"from sqlalchemy import Column\nclass Big(Base):\n{fields}\nx = 1\ny = Column(Integer)\n"
    tables = D.schema_tables(D.schema_models(make_files(("r", "m.py", text))))
    assert tables.selectExpr("name", "size(columns)").first() == ("big", 20000)


def test_any_nesting(make_files):
    """Bodies nested 1 to 40 deep, a header inside a body, and bodies that are never closed."""
    depths = range(1, 41)
    nest = lambda n, a="(", b=")": a * n + "1" + b * n
    sql = "\n".join(f"CREATE TABLE t{n} (\n  a INT CHECK {nest(n)},\n  b TEXT\n);" for n in depths)
    fields = "\n".join(f"    c{n} = Column(Integer, default=f{nest(n)}, unique=True)" for n in depths)
    python = f"from sqlalchemy import Column\nclass Deep(Base):\n{fields}\n    d = Column(Integer, ("
    prisma = "\n".join(f"model M{n} {{\n  id Int @id\n  j Json @default({nest(n, '{', '}')})\n}}" for n in depths)
    outer = "CREATE TABLE o (\n  a INT, -- CREATE TABLE i (x INT)\n  b TEXT\n);\nCREATE TABLE u (\n  a INT, (\n"
    files = make_files(
        ("r", "d.sql", sql), ("r", "d.py", python), ("r", "schema.prisma", prisma), ("o", "o.sql", outer)
    )
    found = D.schema_tables(D.schema_models(files)).selectExpr("repo_id", "name", "size(columns) n")
    expected = {("r", f"t{n}", 2) for n in depths} | {("r", f"m{n}", 2) for n in depths}
    assert {tuple(r) for r in found.collect()} == expected | {("r", "deep", 40), ("o", "o", 2), ("o", "i", 1)}


def bodies_of(text, header, opening="(", closing=")"):
    """Names and bodies by counting brackets from each header on."""
    out = []
    for m in re.finditer(header, text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {opening: 1, closing: -1}.get(text[at], 0)
            at += 1
        if not depth:
            out.append((m[1], text[m.end() : at - 1]))
    return out


def test_bodies_equal_counting_from_each_header(spark):
    rng = random.Random(9)
    parts = ["T(", "T (", "(", ")", "))", "x", "é漢", "\n", "a, b", "T(x)", ""]
    texts = ["", "T(", "T()", "T(T(T(a)b)c", ")))T(a)", "T(" * 9 + ")" * 4]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    got = {r.id: [tuple(b) for b in r.b] for r in df.select("id", D._blocks(df.text, r"(T) ?\(").alias("b")).collect()}
    assert got == {i: bodies_of(t, r"(T) ?\(") for i, t in enumerate(texts)}


def test_time_of_many_headers_is_linear(spark, make_files):
    """5,000 tables, and as many headers of which none is closed, against 1,250."""

    def took(n, closed):
        text = "\n".join(f"CREATE TABLE t{i} (\n  id INT,\n  v VARCHAR(20)\n{');' if closed else ''}" for i in range(n))
        models = D.schema_models(make_files(("r", "schema.sql", text)))
        start = time.time()
        found = models.count()
        assert found == (n if closed else 0)
        return time.time() - start

    for closed in (True, False):
        took(50, closed)
        assert took(5_000, closed) < 8 * took(1_250, closed) + 2
