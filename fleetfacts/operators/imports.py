"""Import edges between source files.

A target exists or not independently of who imports it, so the file table is turned into an
index of importable names and every import is one equi-join against it. Imports are joined
as they are (one row each), instead of one row per candidate path; the skew of a widely
imported module is on the import side of an inner join, which AQE splits.

Most files are imported by nobody and most imports name no file of their repository, so two
filters keep those rows out of the join's shuffles. The index holds names of directories that
some import points into, and only imports that may name a file of that index are joined. A
filter may let through more, which costs rows in the join, but keeps nothing back. For the first
one the imports are extracted twice instead of being stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts.functions import text as X
from fleetfacts.operators.inventory import exclude_vendored

# A statement starts a line. The word comes first, so that a search for it skips by its length.
_PY_IMPORT = r"(?dmU)import(?<![^\n]import)\s+(\S+)"
_PY_FROM = r"(?dmU)from(?<![^\n]from)\s+(\S+)\s+import"
_TS_IMPORT = r"""(?dU)import\s+.*?\s+from\s+['"]([^'"]+)['"]"""


# 64-bit words of a filter, a power of two: at most 8 MB of bits for any number of keys, broadcast as rows of one word.
_FILTER_WORDS = 1 << 20
# Joins test for nulls where they begin; as all passes do, they share the files' shuffle.
_KEYED = "repo_id IS NOT NULL AND import_key IS NOT NULL"


def python_imports(files: DataFrame) -> DataFrame:
    """Distinct top-level imported modules per Python file."""
    content = F.col("content")
    modules = F.array_distinct(
        F.concat(X.extract_all(content, _PY_IMPORT), X.extract_all(content, _PY_FROM))
    )
    return (
        exclude_vendored(files.where(X.has_extension(F.col("path"), ".py")))
        .select("repo_id", "path", F.explode(modules).alias("module"))
    )


def ts_imports(files: DataFrame) -> DataFrame:
    """Distinct `import … from '…'` targets per TypeScript or JavaScript file."""
    targets = F.array_distinct(X.extract_all(F.col("content"), _TS_IMPORT))
    return (
        exclude_vendored(files.where(X.has_extension(F.col("path"), *C.SCRIPT_EXTENSIONS)))
        .select("repo_id", "path", F.explode(targets).alias("target"))
    )


def _place(*key: Column) -> tuple[Column, Column]:
    """A key's word in a filter and its two bits in the word."""
    hashed = F.xxhash64(*key)

    def bit(shift: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(hashed, shift).bitwiseAND(63).cast("int"))

    return hashed.bitwiseAND(_FILTER_WORDS - 1), bit(32).bitwiseOR(bit(40))


def _filter(rows: DataFrame, *key: Column) -> DataFrame:
    """Bloom filter of the rows' keys: words that hold any and their bits."""
    word, bits = _place(*key)
    return rows.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("held"))


def _passing(rows: DataFrame, held: DataFrame, *key: Column) -> DataFrame:
    """Rows whose key may be in a filter."""
    word, bits = _place(*key)
    placed = rows.select("*", word.alias("word"), bits.alias("bits"))
    found = placed.join(F.broadcast(held), "word").where(F.col("held").bitwiseAND(F.col("bits")) == F.col("bits"))
    return found.select(*rows.columns)


def _names(files: DataFrame, keys: list[Column]) -> DataFrame:
    """(repo_id, import_key, rank) of every name of every file."""
    return (
        files.select("repo_id", F.explode(F.array(*keys)).alias("k"))
        .where("k IS NOT NULL")
        .select("repo_id", "k.import_key", "k.rank")
        .where(_KEYED)
    )


def _index(names: DataFrame) -> DataFrame:
    """Best rank per importable name.

    A name and a rank spell the file's path, so only the smallest rank is aggregated (a hash
    aggregate over an integer) and no path is shuffled.
    """
    return names.groupBy("repo_id", "import_key").agg(F.min("rank").alias("rank"))


def _key(key: Column, rank: Column | int) -> Column:
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    return F.struct(key.alias("import_key"), rank.cast("int").alias("rank"))


def python_module_names(files: DataFrame) -> DataFrame:
    """Names under which a Python file can be imported: from the root and from `src`.

    Ranks in order of preference: m.py, m/__init__.py, src/m.py, src/m/__init__.py.
    """
    path = F.col("path")
    package = path.endswith("/__init__.py")
    in_src = path.startswith("src/")
    stem = F.substr(path, F.lit(1), F.length(path) - len(".py"))
    folder = F.substr(path, F.lit(1), F.length(path) - len("/__init__.py"))

    def below_src(text: Column) -> Column:
        return F.substr(text, F.lit(len("src/") + 1))

    keys = [
        _key(stem, 0),
        F.when(package, _key(folder, 1)),
        F.when(in_src, _key(below_src(stem), 2)),
        F.when(in_src & package & (folder != "src"), _key(below_src(folder), 3)),
    ]
    return _names(exclude_vendored(files.where(path.endswith(".py"))), keys)


def _python_path(key: Column, rank: Column) -> Column:
    return F.concat(
        F.when(rank >= 2, "src/").otherwise(""),
        key,
        F.when(rank % 2 == 1, "/__init__.py").otherwise(".py"),
    )


def ts_target_names(files: DataFrame) -> DataFrame:
    """Paths under which a file can be imported: itself, without extension, as an index.

    Rank 0 is the exact path; then each extension has a rank for the file (odd) before one
    for the directory's index file (even). A bare directory resolves to its index file.
    """
    path, at = F.col("path"), F.col("at")
    placed = exclude_vendored(files).select(
        "repo_id", "path", X.extension_place(path, C.SCRIPT_EXTENSIONS).alias("at")
    )
    extension = F.element_at(X.string_array(C.SCRIPT_EXTENSIONS), at)
    stem = F.substr(path, F.lit(1), F.length(path) - F.length(extension))
    index = F.concat(F.lit("/index"), extension)
    is_index = F.concat(F.lit("/"), path).endswith(index)
    keys = [
        _key(path, 0),
        F.when(at > 0, _key(stem, 2 * at - 1)),
        F.when((at > 0) & is_index, _key(X.parent_dir(path), 2 * at)),
    ]
    return _names(placed, keys)


def _ts_path(key: Column, rank: Column) -> Column:
    extension = F.element_at(X.string_array(C.SCRIPT_EXTENSIONS), F.expr("(rank + 1) div 2").cast("int"))
    folder = F.when(key == "", "").otherwise(F.concat(key, F.lit("/")))
    return (
        F.when(rank == 0, key)
        .when(rank % 2 == 1, F.concat(key, extension))
        .otherwise(F.concat(folder, F.lit("index"), extension))
    )


def _resolve(imports: DataFrame, names: DataFrame, target: Column) -> DataFrame:
    imports = imports.where(_KEYED)
    key = [F.col("repo_id"), F.col("import_key")]
    directory = [F.col("repo_id"), X.parent_dir(F.col("import_key"))]
    index = _index(_passing(names, _filter(imports, *directory), *directory))
    # Reads the rank, so that this and the join share one plan of the index, hence its shuffle.
    known = _filter(index.where("rank >= 0"), *key)
    return (
        _passing(imports, known, *key)
        .join(index, ["repo_id", "import_key"])
        .select("repo_id", F.col("path").alias("from_component"), target.alias("to_component"))
        .where("from_component <> to_component")
    )


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges to the file each module names; unresolved imports and self-edges drop out."""
    keyed = imports.withColumn("import_key", F.replace("module", F.lit("."), F.lit("/")))
    return _resolve(
        keyed, python_module_names(files), _python_path(F.col("import_key"), F.col("rank"))
    )


def resolve_ts_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of relative imports that stay inside the repository."""
    target = F.col("target")
    relative = target.startswith("./") | target.startswith("../")
    placed = imports.where(relative).withColumns(
        {"directory": X.parent_dir(F.col("path")), "lead": X.relative_lead(target)}
    )
    # Resolved below an explode, so that the condition on the key does not resolve a second time.
    resolved = placed.withColumn("key", X.resolve_relative(F.col("directory"), target, F.col("lead")))
    keyed = resolved.select("repo_id", "path", F.explode(F.array("key")).alias("import_key"))
    inside = F.col("import_key") != X.OUTSIDE
    return _resolve(
        keyed.where(inside),
        ts_target_names(files).where(inside),
        _ts_path(F.col("import_key"), F.col("rank")),
    )


def import_edges(files: DataFrame) -> DataFrame:
    """Two modules of one file that resolve to the same file give two edges."""
    edges = resolve_python_imports(python_imports(files), files).unionByName(
        resolve_ts_imports(ts_imports(files), files)
    )
    return edges.select(
        "repo_id",
        "from_component",
        "to_component",
        F.lit("imports").alias("type"),
        F.lit(0.6).alias("confidence"),
        F.lit(True).alias("inferred"),
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct edge endpoints, labelled by their last path segment."""
    ends = edges.select(
        "repo_id", F.explode(F.array("from_component", "to_component")).alias("path")
    ).distinct()
    return ends.select(
        "repo_id", "path", X.file_name(F.col("path")).alias("name"), F.lit("unknown").alias("type")
    )


def architecture(edges: DataFrame, repo_ids: list[str]) -> DataFrame:
    """Edges of the named repositories; the filter reaches the scan of a stored edge table."""
    return edges.where(F.col("repo_id").isin(repo_ids)).select(
        "repo_id",
        F.col("from_component").alias("from"),
        F.col("to_component").alias("to"),
        "type",
        "inferred",
        "confidence",
    )
