"""Tables, columns and foreign keys found in SQL, SQLAlchemy, Django and Prisma sources.

One pass over the candidate files turns each text into an array of models (a table with its
columns and relationships) by array expressions, so up to the per-repository deduplication
there is no shuffle and no window: a class body is cut out by splitting the text at
top-level lines, a bracketed body by cutting the text at each bracket and folding a running
depth, however deep it is nested.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts import schemas as S
from fleetfacts.functions import text as X
from fleetfacts.operators.inventory import exclude_vendored

# Patterns that define what counts as a declaration.
_SQL_TABLE = r"""(?iU)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"]?(\w+)[`"]?\s*\("""
_SQL_CONSTRAINT_LINE = (
    r"(?iU)^(?:PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE\s+KEY|INDEX|KEY\s+|CHECK\s*\(|CONSTRAINT\s+)"
)
_SQL_COLUMN = r"""(?U)^[`"]?(\w+)[`"]?\s+(\w+)"""
_REFERENCE = r"""REFERENCES\s+[`"]?(\w+)[`"]?\s*\(\s*[`"]?(\w+)[`"]?\s*\)"""
_SQL_REFERENCE = "(?iU)" + _REFERENCE
_SQL_FOREIGN_KEY = r"""(?iU)FOREIGN\s+KEY\s*\(\s*[`"]?(\w+)[`"]?\s*\)\s+""" + _REFERENCE

_SA_IMPORT = r"(?U)(?:from|import)\s+sqlalchemy"
_SA_NAMES = ["declarative_base", "DeclarativeBase", "mapped_column"]
_SA_CLASS = r"(?dU)^class\s+(\w+)\s*\(.*(?:Base|db\.Model|DeclarativeBase|Model).*\)\s*:"
_SA_TABLENAME = r"""(?U)__tablename__\s*=\s*['"](\w+)['"]"""
# A name starts where a word does and is taken whole, so that no part of a word is tried again.
_SA_COLUMN = r"(?sU)(?<!\w)(\w++)\s*+(?::\s*Mapped\[.*?\])?\s*=\s*(?:mapped_column|Column)\s*\("
_SA_FOREIGN_KEY = r"""(?U)ForeignKey\s*\(\s*['"]([^'"]+)['"]\s*\)"""
_SA_RELATIONSHIP = r"""(?U)(?<!\w)(\w++)\s*+=\s*relationship\s*\(\s*['"](\w+)['"]"""

_DJ_IMPORT = r"(?U)from\s+django\.db\s+import\s+models"
_DJ_CLASS = r"(?U)^class\s+(\w+)\s*\(\s*(?:models\.Model|Model)\s*\)\s*:"
_DJ_TABLE = r"""(?U)db_table\s*=\s*['"](\w+)['"]"""
_DJ_FIELD = r"(?U)(?<!\w)(\w++)\s*+=\s*models\.(\w+)\s*\(([^)]*)\)"

_PRISMA_MODEL = r"(?dmU)^model\s+(\w+)\s*\{"
_PRISMA_FIELD = r"(?dmU)^[^\S\n]+(\w+)[^\S\n]+(\w+)(\??)[^\S\n]*(.*)$"
_PRISMA_RELATION = r"(?sU)fields:\s*\[(\w+)\].*?references:\s*\[(\w+)\]"

MODELS = f"array<{S.MODEL_STRUCT}>"
RELATIONS = f"array<{S.RELATION_STRUCT}>"


def _column(
    name: Column,
    data_type: Column,
    primary_key: Column,
    foreign_key: Column,
    nullable: Column,
    unique: Column,
    default: Column,
) -> Column:
    return F.struct(
        name.alias("name"),
        data_type.alias("data_type"),
        primary_key.alias("primary_key"),
        foreign_key.alias("foreign_key"),
        nullable.alias("nullable"),
        unique.alias("unique"),
        default.alias("default"),
    )


def _relation(
    from_column: Column, to_table: Column, to_column: Column, kind: Column, inferred: bool
) -> Column:
    return F.struct(
        from_column.alias("from_column"),
        to_table.alias("to_table"),
        to_column.cast("string").alias("to_column"),
        kind.alias("relationship_type"),
        F.lit(inferred).alias("inferred"),
    )


def _model(
    name: Column,
    columns: Column,
    relationships: Column,
    source_type: str,
    confidence: float,
    is_table: Column,
) -> Column:
    return F.struct(
        name.alias("name"),
        columns.cast(f"array<{S.COLUMN_STRUCT}>").alias("columns"),
        relationships.cast(RELATIONS).alias("relationships"),
        F.lit(source_type).alias("source_type"),
        F.lit(confidence).alias("confidence"),
        is_table.alias("is_table"),
    )


# Values that are summed one after the other by appending to an array; longer arrays are cut.
_RUNNING = 64


def _running_sums(values: Column) -> Column:
    """Sums up to each value of an array of integers, in pieces, so that no long array is copied for each value."""

    def appended(part: Column, start: Column) -> Column:
        def step(state: Column, value: Column) -> Column:
            total = state["total"] + value
            return F.struct(F.concat(state["sums"], F.array(total)).alias("sums"), total.alias("total"))

        nothing = F.struct(F.array().cast("array<int>").alias("sums"), start.alias("total"))
        return F.aggregate(part, nothing, step, lambda s: s["sums"])

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda total, v: total + v))
        return X.let(
            appended(totals, F.lit(0)),
            lambda ends: F.flatten(F.transform(parts, lambda p, k: appended(p, F.coalesce(F.get(ends, k - 1), F.lit(0))))),
        )

    def cut(whole: Column) -> Column:
        last = F.floor(F.greatest(F.size(whole) - 1, F.lit(0)) / _RUNNING).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(whole, k * _RUNNING + 1, _RUNNING))

    return X.let(X.let(values, cut), summed)


# Brackets within brackets that one pattern follows; deeper ones are followed by their running depth.
_NESTED = 4


def _blocks(text: Column, header: str, opening: str = "(", closing: str = ")") -> Column:
    """array<struct(name, body)> of the headers, which end with an opening bracket.

    Usually one pattern takes each header with its body. Where some header is not closed, nested too
    deep or within another's body, the running depth of the whole text decides.
    """
    inside = rf"[^\{opening}\{closing}]++"
    balanced = rf"(?:{inside})?+"
    for _ in range(_NESTED):
        balanced = rf"(?:{inside}|\{opening}{balanced}\{closing})*+"
    block = rf"{header}((?:{balanced}\{closing})?+)"
    taken = F.struct(
        X.extract_all(text, block, 1).alias("names"), X.extract_all(text, block, 2).alias("bodies")
    )

    def bodies(found: Column) -> Column:
        usual = F.forall(found["bodies"], lambda b: (b != "") & ~b.rlike(header))
        pairs = F.transform(found["bodies"], lambda b, i: F.struct(
            F.get(found["names"], i).alias("name"), F.substr(b, F.lit(1), F.length(b) - 1).alias("body")
        ))
        return F.when(usual, pairs).otherwise(_blocks_by_depth(text, header, opening, closing))

    return X.let(taken, bodies)


def _blocks_by_depth(text: Column, header: str, opening: str, closing: str) -> Column:
    """The blocks of any text.

    The text is cut after each bracket and the depth there is summed once. Where brackets and
    headers are sorted by depth, then place, a header is followed by the bracket that closes it,
    the first one that leads back to the depth before it. Bodies that are never closed are left out.
    """

    def bodies(cut: Column) -> Column:
        turn = lambda p: F.when(p.endswith(opening), 1).when(p.endswith(closing), -1).otherwise(0)
        measured = F.struct(
            _running_sums(F.transform(cut["pieces"], F.length)).alias("ends"),
            _running_sums(F.transform(cut["pieces"], turn)).alias("depths"),
            _running_sums(F.transform(cut["heads"], lambda h, i: F.length(F.get(cut["after"], i)) + F.length(h))).alias("heads"),
        )
        return X.let(measured, lambda sums: X.let(levels(cut, sums), lambda found: closed(cut, found)))

    def levels(cut: Column, sums: Column) -> Column:
        """(depth, piece, head): headers at the depth before them, closing brackets (head -1) at the depth after."""
        entry = lambda depth, piece, head: F.struct(depth.alias("depth"), piece.alias("piece"), head.alias("head"))
        mark = lambda at, head, piece: F.struct(at.alias("at"), head.alias("head"), piece.alias("piece"))
        # A header ends where the piece with its bracket does, so it stands right after that piece.
        marks = F.array_sort(F.concat(
            F.transform(sums["ends"], lambda at, i: mark(at, F.lit(-1), i)),
            F.transform(sums["heads"], lambda at, i: mark(at, i, F.lit(-1))),
        ))
        headers = X.let(marks, lambda m: F.transform(
            F.filter(
                F.transform(m, lambda x, k: F.struct(x["head"].alias("head"), F.get(m, k - 1)["piece"].alias("piece"))),
                lambda x: x["head"] >= 0,
            ),
            lambda x: entry(F.get(sums["depths"], x["piece"]) - 1, x["piece"], x["head"]),
        ))
        closings = F.filter(
            F.transform(sums["depths"], lambda depth, i: entry(depth, i, F.lit(-1))),
            lambda e: F.get(cut["pieces"], e["piece"]).endswith(closing),
        )
        return F.array_sort(F.concat(headers, closings))

    def closed(cut: Column, found: Column) -> Column:
        def one(level: Column, k: Column) -> Column:
            after = F.get(found, k + 1)
            inside = F.array_join(F.slice(cut["pieces"], level["piece"] + 2, after["piece"] - level["piece"]), "")
            ends = (level["head"] >= 0) & (after["head"] == -1) & (after["depth"] == level["depth"])
            return F.struct(
                level["head"].alias("head"),
                F.when(ends, F.substr(inside, F.lit(1), F.length(inside) - 1)).alias("body"),
            )

        kept = F.filter(F.transform(found, one), lambda b: b["body"].isNotNull())
        return F.transform(F.array_sort(kept), lambda b: F.struct(
            F.regexp_extract(F.get(cut["heads"], b["head"]), header, 1).alias("name"), b["body"].alias("body")
        ))

    heads = X.extract_all(text, header, 0)
    cut = F.struct(
        heads.alias("heads"), F.split(text, header).alias("after"), F.split(text, rf"(?<=[\{opening}\{closing}])").alias("pieces")
    )
    none = F.array().cast("array<struct<name: string, body: string>>")
    return F.when(F.size(heads) > 0, X.let(cut, bodies)).otherwise(none)


def _split_reference(reference: Column) -> tuple[Column, Column]:
    parts = F.split(reference, r"\.")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def _own_references(columns: Column) -> Column:
    """One-to-many relationships of the columns that carry a foreign key."""

    def one(col: Column) -> Column:
        table, column = _split_reference(col["foreign_key"])
        return _relation(col["name"], table, column, F.lit("one_to_many"), False)

    keyed = F.filter(columns, lambda c: c["foreign_key"].isNotNull())
    return F.transform(keyed, one).cast(RELATIONS)


# --- SQL -----------------------------------------------------------------------------


def _sql_column(line: Column) -> Column:
    pk = line.rlike(r"(?iU)\bPRIMARY\s+KEY\b")
    target = X.extract(line, _SQL_REFERENCE, 1)
    return _column(
        X.extract(line, _SQL_COLUMN, 1),
        X.normalise_sql_type(X.extract(line, _SQL_COLUMN, 2)),
        pk,
        F.concat(target, F.lit("."), X.extract(line, _SQL_REFERENCE, 2)),
        ~line.rlike(r"(?iU)\bNOT\s+NULL\b") & ~pk,
        line.rlike(r"(?iU)\bUNIQUE\b"),
        X.extract(line, r"(?iU)\bDEFAULT\s+(\S+)"),
    )


_NOT_COLUMNS = ["PRIMARY", "FOREIGN", "UNIQUE", "INDEX", "KEY", "CONSTRAINT", "CHECK"]


def sql_columns(body: Column) -> Column:
    """Column structs of a CREATE TABLE body, one per line that declares a column."""
    stripped = F.transform(
        F.split(body, "\n"), lambda l: F.rtrim(X.strip(l), F.lit(","))
    )
    declared = F.filter(
        stripped, lambda l: ~l.rlike(_SQL_CONSTRAINT_LINE) & l.rlike(_SQL_COLUMN)
    )
    return F.filter(
        F.transform(declared, _sql_column), lambda c: ~F.upper(c["name"]).isin(_NOT_COLUMNS)
    )


def sql_foreign_keys(body: Column) -> Column:
    """Table-level FOREIGN KEY constraints of a CREATE TABLE body."""
    return F.transform(
        X.extract_all(body, _SQL_FOREIGN_KEY, 0),
        lambda m: _relation(
            X.extract(m, _SQL_FOREIGN_KEY, 1),
            X.extract(m, _SQL_FOREIGN_KEY, 2),
            X.extract(m, _SQL_FOREIGN_KEY, 3),
            F.lit("one_to_many"),
            False,
        ),
    ).cast(RELATIONS)


def sql_models(content: Column) -> Column:
    def one(block: Column) -> Column:
        body = block["body"]
        return X.let(
            sql_columns(body),
            lambda columns: _model(
                block["name"],
                columns,
                F.concat(sql_foreign_keys(body), _own_references(columns)),
                "sql",
                1.0,
                (F.size(columns) > 0) | (X.strip(body) != ""),
            ),
        )

    return F.transform(_blocks(content, _SQL_TABLE), one).cast(MODELS)


# --- Python classes ------------------------------------------------------------------

# A line that starts a new top-level statement: not blank, not indented, not a comment. A
# closing parenthesis with a colon still belongs to the class header above it.
_TOP_LEVEL = r"(?U)\n(?=[^\s#])(?!\)\s*:)"


def _classes(content: Column, header: str) -> Column:
    """array<struct(name, body)> of the top-level classes whose header matches."""
    heads = F.filter(F.split(content, _TOP_LEVEL), lambda s: s.rlike(header))

    def one(segment: Column) -> Column:
        rest = F.concat(F.lit("\n"), F.regexp_replace(segment, header, ""))
        return F.struct(
            F.regexp_extract(segment, header, 1).alias("name"),
            F.get(F.split(rest, r"(?U)\n(?=[^\s#])", 2), F.lit(0)).alias("body"),
        )

    return F.transform(heads, one)


def sqlalchemy_columns(body: Column) -> Column:
    def one(block: Column) -> Column:
        args = block["body"]
        pk = args.rlike(r"(?U)primary_key\s*=\s*True")
        stated = X.extract(args, r"(?U)nullable\s*=\s*(True|False)")
        return _column(
            block["name"],
            X.normalise_sql_type(X.extract(args, r"(?U)^\s*(\w+)")),
            pk,
            X.extract(args, _SA_FOREIGN_KEY),
            F.coalesce(stated == "True", ~pk),
            args.rlike(r"(?U)unique\s*=\s*True"),
            X.extract(args, r"(?U)default\s*=\s*(\S+?)[,)]"),
        )

    public = F.filter(_blocks(body, _SA_COLUMN), lambda b: ~b["name"].startswith("_"))
    return F.transform(public, one)


def sqlalchemy_relationships(body: Column) -> Column:
    return F.transform(
        X.extract_all(body, _SA_RELATIONSHIP, 0),
        lambda m: _relation(
            X.extract(m, _SA_RELATIONSHIP, 1),
            F.lower(X.extract(m, _SA_RELATIONSHIP, 2)),
            F.lit(None),
            F.lit("unknown"),
            True,
        ),
    ).cast(RELATIONS)


def sqlalchemy_models(content: Column) -> Column:
    def one(cls: Column) -> Column:
        body = cls["body"]
        return X.let(
            sqlalchemy_columns(body),
            lambda columns: _model(
                F.coalesce(X.extract(body, _SA_TABLENAME), F.lower(cls["name"])),
                columns,
                F.concat(_own_references(columns), sqlalchemy_relationships(body)),
                "sqlalchemy",
                0.9,
                F.size(columns) > 0,
            ),
        )

    return F.transform(_classes(content, _SA_CLASS), one).cast(MODELS)


def django_fields(body: Column) -> Column:
    """array<struct(name, kind, args, related)> of the model fields of a class body."""

    def one(m: Column) -> Column:
        kind = X.extract(m, _DJ_FIELD, 2)
        args = F.regexp_extract(m, _DJ_FIELD, 3)
        target = X.extract(args, r"""(?U)^\s*['"]?(\w+)['"]?""")
        is_relation = kind.isin(list(C.DJANGO_CARDINALITY))
        return F.struct(
            X.extract(m, _DJ_FIELD, 1).alias("name"),
            kind.alias("kind"),
            args.alias("args"),
            F.when(is_relation & (target != "self"), F.lower(target)).alias("related"),
        )

    fields = F.transform(X.extract_all(body, _DJ_FIELD, 0), one)
    return F.filter(
        fields, lambda f: ~f["name"].isin("Meta", "objects") & ~f["name"].startswith("_")
    )


def django_columns(fields: Column) -> Column:
    direct = F.filter(fields, lambda f: f["kind"] != "ManyToManyField")
    return F.transform(
        direct,
        lambda f: _column(
            f["name"],
            F.coalesce(X.lookup(C.DJANGO_TYPES, f["kind"]), F.upper(f["kind"])),
            f["kind"].isin("AutoField", "BigAutoField"),
            f["related"],
            f["args"].rlike(r"(?U)null\s*=\s*True"),
            f["args"].rlike(r"(?U)unique\s*=\s*True"),
            F.lit(None).cast("string"),
        ),
    )


def django_relationships(fields: Column) -> Column:
    related = F.filter(fields, lambda f: f["related"].isNotNull())
    return F.transform(
        related,
        lambda f: _relation(
            f["name"],
            f["related"],
            F.lit(None),
            X.lookup(C.DJANGO_CARDINALITY, f["kind"]),
            False,
        ),
    ).cast(RELATIONS)


def django_models(content: Column) -> Column:
    def one(cls: Column) -> Column:
        body = cls["body"]
        return X.let(
            django_fields(body),
            lambda fields: _model(
                F.coalesce(X.extract(body, _DJ_TABLE), F.lower(cls["name"])),
                django_columns(fields),
                django_relationships(fields),
                "django",
                0.9,
                F.exists(fields, lambda f: f["kind"] != "ManyToManyField"),
            ),
        )

    return F.transform(_classes(content, _DJ_CLASS), one).cast(MODELS)


# --- Prisma --------------------------------------------------------------------------


def prisma_fields(body: Column) -> Column:
    """array<struct(name, kind, optional, modifiers, is_scalar)> of a model body."""

    def one(m: Column) -> Column:
        kind = X.extract(m, _PRISMA_FIELD, 2)
        return F.struct(
            X.extract(m, _PRISMA_FIELD, 1).alias("name"),
            kind.alias("kind"),
            (F.regexp_extract(m, _PRISMA_FIELD, 3) == "?").alias("optional"),
            F.regexp_extract(m, _PRISMA_FIELD, 4).alias("modifiers"),
            (~kind.rlike(r"^\p{Lu}") | kind.isin(list(C.PRISMA_TYPES))).alias("is_scalar"),
        )

    return F.transform(X.extract_all(body, _PRISMA_FIELD, 0), one)


def prisma_columns(fields: Column) -> Column:
    scalars = F.filter(fields, lambda f: f["is_scalar"])
    return F.transform(
        scalars,
        lambda f: _column(
            f["name"],
            F.coalesce(X.lookup(C.PRISMA_TYPES, f["kind"]), F.upper(f["kind"])),
            f["modifiers"].contains("@id"),
            F.lit(None).cast("string"),
            f["optional"],
            f["modifiers"].contains("@unique"),
            X.extract(f["modifiers"], r"@default\(([^)]+)\)"),
        ),
    )


def prisma_relationships(fields: Column) -> Column:
    related = F.filter(
        fields,
        lambda f: ~f["is_scalar"]
        & f["modifiers"].contains("@relation")
        & f["modifiers"].rlike(_PRISMA_RELATION),
    )
    return F.transform(
        related,
        lambda f: _relation(
            X.extract(f["modifiers"], _PRISMA_RELATION, 1),
            F.lower(f["kind"]),
            X.extract(f["modifiers"], _PRISMA_RELATION, 2),
            F.lit("one_to_many"),
            False,
        ),
    ).cast(RELATIONS)


def prisma_models(content: Column) -> Column:
    def one(block: Column) -> Column:
        return X.let(
            prisma_fields(block["body"]),
            lambda fields: _model(
                F.lower(block["name"]),
                prisma_columns(fields),
                prisma_relationships(fields),
                "prisma",
                1.0,
                F.exists(fields, lambda f: f["is_scalar"]),
            ),
        )

    return F.transform(_blocks(content, _PRISMA_MODEL, "{", "}"), one).cast(MODELS)


# --- per repository ------------------------------------------------------------------


def _uses_sqlalchemy(content: Column) -> Column:
    imported = X.contains_word(content, "sqlalchemy") & content.rlike(_SA_IMPORT)
    return imported | X.contains_any(content, _SA_NAMES)


def _uses_django(content: Column) -> Column:
    return X.contains_word(content, "django.db") & content.rlike(_DJ_IMPORT)


def schema_candidates(files: DataFrame) -> DataFrame:
    """Files worth parsing, with the parsers that apply. A file may pass both Python gates."""
    is_sql = X.has_extension(F.col("path"), ".sql")
    is_prisma = ~is_sql & F.lower("path").endswith("schema.prisma")
    is_python = ~is_prisma & X.has_extension(F.col("path"), ".py")
    gated = exclude_vendored(files).select(
        "repo_id",
        "path",
        "content",
        is_sql.alias("is_sql"),
        is_prisma.alias("is_prisma"),
        (is_python & _uses_sqlalchemy(F.col("content"))).alias("is_sqlalchemy"),
        (is_python & _uses_django(F.col("content"))).alias("is_django"),
    )
    return gated.where("is_sql OR is_prisma OR is_sqlalchemy OR is_django")


PARSERS = {
    "sql": sql_models,
    "prisma": prisma_models,
    "sqlalchemy": sqlalchemy_models,
    "django": django_models,
}


def schema_models(files: DataFrame, dialects: Iterable[str] = tuple(PARSERS)) -> DataFrame:
    """Every model found, in reading order within its file, before deduplication.

    Only files of the named dialects are read and only their parsers run; `ordinal` counts the
    models of those.
    """
    wanted = [d for d in PARSERS if d in set(dialects)]
    if not wanted or set(dialects) - set(wanted):
        raise ValueError(f"dialects are some of {', '.join(PARSERS)}")
    none = F.array().cast(MODELS)
    parsed = [F.when(F.col(f"is_{d}"), PARSERS[d](F.col("content"))).otherwise(none) for d in wanted]
    models = F.concat(*parsed)
    return (
        schema_candidates(files)
        .where(" OR ".join(f"is_{d}" for d in wanted))
        .select("repo_id", F.col("path").alias("source"), F.posexplode(models))
        .select("repo_id", "source", F.col("pos").alias("ordinal"), "col.*")
    )


def schema_tables(models: DataFrame) -> DataFrame:
    """One table per name and repository: highest confidence, then first in (path, order).

    Columns stay nested in the table row, so the winner brings its columns without a join
    and copies of one declaration are combined before the shuffle.
    """
    order = F.struct((-F.col("confidence")).alias("c"), "source", "ordinal")
    row = F.struct("columns", "source", "source_type", "confidence")
    return (
        models.where("is_table")
        .groupBy("repo_id", "name")
        .agg(F.min_by(row, order).alias("best"))
        .select("repo_id", "name", "best.*")
    )


def schema_columns(tables: DataFrame) -> DataFrame:
    return tables.select(
        "repo_id",
        F.col("name").alias("table_name"),
        F.posexplode("columns").alias("ordinal", "c"),
        "source",
    ).select("repo_id", "table_name", "ordinal", "c.*", "source")


def declared_relationships(models: DataFrame) -> DataFrame:
    """Every relationship found, with its place in the reading order."""
    return models.select(
        "repo_id",
        F.col("name").alias("from_table"),
        "source",
        "source_type",
        "ordinal",
        F.posexplode("relationships").alias("place", "r"),
    ).select(
        "repo_id", "from_table", "r.from_column", "r.to_table", "r.to_column",
        "r.relationship_type", "source", "r.inferred", "source_type", "ordinal", "place",
    )


def schema_relationships(models: DataFrame) -> DataFrame:
    """First relationship per endpoint pair in (path, order)."""
    keys = ["repo_id", "from_table", "from_column", "to_table", "to_column"]
    order = F.struct("source", "ordinal", "place")
    row = F.struct("relationship_type", "source", "inferred")
    return (
        declared_relationships(models)
        .groupBy(*keys)
        .agg(F.min_by(row, order).alias("first"))
        .select(*keys, "first.*")
    )


def schema_overview(
    repositories: DataFrame, tables: DataFrame, relationships: DataFrame
) -> DataFrame:
    """Counts per repository; a repository without a schema is a row with detected = false."""

    def flagged(condition: str) -> Column:
        return F.expr(f"size(filter(columns, c -> {condition}))")

    by_table = tables.groupBy("repo_id").agg(
        F.count("*").alias("table_count"),
        F.sum(F.size("columns")).alias("column_count"),
        F.sum(flagged("c.primary_key")).alias("primary_key_count"),
        F.sum(flagged("c.foreign_key is not null")).alias("foreign_key_count"),
        F.sum(flagged("c.unique and not c.primary_key")).alias("unique_count"),
        F.sum(flagged("c.nullable")).alias("nullable_count"),
    )
    by_relation = relationships.groupBy("repo_id").agg(F.count("*").alias("relationship_count"))
    joined = (
        repositories.select("repo_id")
        .join(by_table, "repo_id", "left")
        .join(by_relation, "repo_id", "left")
    )
    counts = [c for c in joined.columns if c.endswith("_count")]
    return joined.na.fill(0, counts).select(
        "repo_id", (F.col("table_count") > 0).alias("detected"), *counts
    )
