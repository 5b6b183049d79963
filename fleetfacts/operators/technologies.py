"""Technology detection: evidence rows from manifests and extensions, then one row per name.

Root manifests of all kinds are read in one pass: each becomes an array of evidence by its file
name, without a shuffle. The merge is an aggregate with map-side combine on (repo_id, name);
extension evidence is made distinct first because it has one row per source file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts.functions import text as X
from fleetfacts.functions.toml import TOML_ENTRIES, parse_toml

EVIDENCE = ["repo_id", "name", "version", "source", "confidence", "seq"]

# Place of each source in the reading order; leaves room for line numbers behind it.
STAGE = 1 << 40

ITEMS = "array<struct<name: string, version: string, confidence: double, seq: bigint>>"
PACKAGE_JSON = (
    "dependencies map<string,string>, devDependencies map<string,string>,"
    " scripts map<string,string>"
)


def manifests(files: DataFrame, names: list[str] = C.ROOT_MANIFESTS) -> DataFrame:
    """Root manifests of the named kinds, parsed: the filter on path reaches the scan.

    `pkg` is the package.json object (null when it is not one), `toml` the entries of a TOML
    file (null when unreadable). The UDF sees only TOML texts, and nothing filters on its
    result, which would run it twice.
    """
    path, content = F.col("path"), F.col("content")
    is_object = F.get_json_object(content, "$").startswith("{")
    pkg = F.when((path == "package.json") & is_object, F.from_json(content, PACKAGE_JSON))
    rows = files.where(path.isin(names)).select("repo_id", "path", "content", pkg.alias("pkg"))
    toml_names = [n for n in names if n.endswith(".toml")]
    if not toml_names:
        return rows.withColumn("toml", F.lit(None).cast(TOML_ENTRIES))
    return rows.withColumn("toml", parse_toml(F.when(path.isin(toml_names), content)))


def toml_specs(section: str) -> Column:
    """Entries of one section of a parsed TOML manifest."""
    return F.filter("toml", lambda e: e.section == section)


def section(name: str) -> Column:
    """A string map of package.json, empty when it has none."""
    return F.coalesce(F.col(f"pkg.{name}"), F.create_map().cast("map<string,string>"))


def _item(name: str, version: Column | None, confidence: float, seq: Column | int) -> Column:
    version = F.lit(None) if version is None else version
    return F.struct(
        F.lit(name).alias("name"),
        version.cast("string").alias("version"),
        F.lit(confidence).alias("confidence"),
        (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
    )


def _npm_items() -> Column:
    deps, dev = section("dependencies"), section("devDependencies")

    def declared(*names: str) -> Column:
        found = F.lit(False)
        for n in names:
            found = found | F.map_contains_key(deps, n) | F.map_contains_key(dev, n)
        return found

    def version(packages: Column, name: str) -> Column:
        return F.nullif(F.try_element_at(packages, F.lit(name)), F.lit(""))

    def item(label: str, spec: Column, seq: int, *names: str) -> Column:
        return F.when(declared(*names), _item(label, X.version_number(spec), 1.0, seq))

    ts_spec = F.coalesce(version(dev, "typescript"), version(deps, "typescript"))
    found = F.array_compact(
        F.array(
            _item("Node.js", None, 0.9, 0),
            _item("JavaScript", None, 0.8, 1),
            item("React", version(deps, "react"), 2, "react", "@types/react"),
            item("TypeScript", ts_spec, 3, "typescript", "@types/node"),
            item("Next.js", version(deps, "next"), 4, "next"),
            item("Express", version(deps, "express"), 5, "express"),
        )
    )
    return F.when(F.col("pkg").isNotNull(), found)


def _framework_items(requirements: Column) -> Column:
    """Evidence of the known web frameworks among requirement lines, by line prefix."""

    def one(line: Column, at: Column) -> Column:
        low = F.lower(line)
        match = F.lit(None)
        for prefix, name in reversed(C.PYTHON_FRAMEWORKS):
            version = X.version_number(F.substr(line, F.lit(len(prefix) + 1)))
            match = F.when(low.startswith(prefix), _item(name, version, 1.0, at + 1)).otherwise(
                match
            )
        return match

    return F.array_compact(F.transform(requirements, one))


def _pyproject_items() -> Column:
    """Null, so no evidence at all, when the file cannot be read."""
    requirements = F.transform(toml_specs("project"), lambda e: X.strip(e.spec))
    return F.concat(F.array(_item("Python", None, 1.0, 0)), _framework_items(requirements))


def _requirements_items() -> Column:
    lines = X.manifest_lines(F.col("content"))
    return F.concat(F.array(_item("Python", None, 0.9, 0)), _framework_items(lines))


def _go_items() -> Column:
    version = X.extract(F.col("content"), r"(?dmU)^[^\S\n]*go[^\S\n]+([\d.]+)")
    return F.array(_item("Go", version, 1.0, 0))


def _rust_items() -> Column:
    return F.array(_item("Rust", None, 1.0, 0))


def _docker_items() -> Column:
    images = X.extract_all(F.col("content"), r"(?dmU)^[^\S\n]*(?i:FROM)\S*[^\S\n]+(\S+)")

    def based_on(prefix: str, name: str, seq: int) -> Column:
        return F.when(F.exists(images, lambda i: i.startswith(prefix)), _item(name, None, 0.9, seq))

    return F.array_compact(
        F.array(
            _item("Docker", None, 1.0, 0),
            based_on("python:", "Python", 1),
            based_on("node:", "Node.js", 2),
        )
    )


# Evidence of each manifest, in reading order.
_ITEMS = {
    "package.json": _npm_items,
    "pyproject.toml": _pyproject_items,
    "requirements.txt": _requirements_items,
    "go.mod": _go_items,
    "Cargo.toml": _rust_items,
    "Dockerfile": _docker_items,
}


def manifest_evidence(files: DataFrame, names: list[str] = C.ROOT_MANIFESTS) -> DataFrame:
    """Evidence of the named root manifests, in one pass."""
    items = F.lit(None).cast(ITEMS)
    stage = F.lit(0)
    for at, (name, build) in enumerate(_ITEMS.items(), 1):
        if name in names:
            is_it = F.col("path") == name
            items = F.when(is_it, build()).otherwise(items)
            stage = F.when(is_it, F.lit(at)).otherwise(stage)
    rows = manifests(files, names).select(
        "repo_id", "path", stage.alias("stage"), F.explode(items).alias("e")
    )
    return rows.select(
        "repo_id",
        "e.name",
        "e.version",
        F.col("path").alias("source"),
        "e.confidence",
        (F.col("e.seq") + F.col("stage") * STAGE).alias("seq"),
    )


def npm_evidence(files: DataFrame) -> DataFrame:
    return manifest_evidence(files, ["package.json"])


def pyproject_evidence(files: DataFrame) -> DataFrame:
    return manifest_evidence(files, ["pyproject.toml"])


def requirements_evidence(files: DataFrame) -> DataFrame:
    return manifest_evidence(files, ["requirements.txt"])


def go_evidence(files: DataFrame) -> DataFrame:
    return manifest_evidence(files, ["go.mod"])


def rust_evidence(files: DataFrame) -> DataFrame:
    return manifest_evidence(files, ["Cargo.toml"])


def docker_evidence(files: DataFrame) -> DataFrame:
    return manifest_evidence(files, ["Dockerfile"])


def workflow_evidence(inventory: DataFrame) -> DataFrame:
    return (
        inventory.where(F.col("path").startswith(C.WORKFLOW_PREFIX))
        .groupBy("repo_id")
        .agg(F.min("path").alias("source"))
        .select(
            "repo_id",
            F.lit("GitHub Actions").alias("name"),
            F.lit(None).cast("string").alias("version"),
            "source",
            F.lit(1.0).alias("confidence"),
            F.lit(7 * STAGE).alias("seq"),
        )
    )


def extension_evidence(inventory: DataFrame) -> DataFrame:
    name = X.lookup(C.EXTENSION_LANGUAGES, X.file_extension(F.col("path")))
    return (
        inventory.select("repo_id", name.alias("name"))
        .where("name IS NOT NULL")
        .distinct()
        .select(
            "repo_id",
            "name",
            F.lit(None).cast("string").alias("version"),
            F.lit("file_extension").alias("source"),
            F.lit(0.7).alias("confidence"),
            F.lit(8 * STAGE).alias("seq"),
        )
    )


def technology_evidence(files: DataFrame) -> DataFrame:
    """All evidence; `seq` is the reading order."""
    paths = files.select("repo_id", "path").where(~X.is_vendored(F.col("path"), False))
    return (
        manifest_evidence(files)
        .unionByName(workflow_evidence(paths))
        .unionByName(extension_evidence(paths))
    )


def merge_evidence(evidence: DataFrame, keys: tuple[str, ...] = ("repo_id", "name")) -> DataFrame:
    """Highest confidence per name; then one with a version; then the earliest."""
    rank = F.struct(
        F.col("confidence"), F.col("version").isNotNull(), (-F.col("seq")).alias("first")
    )
    best = F.max_by(F.struct("version", "source", "confidence"), rank)
    return (
        evidence.groupBy(*keys)
        .agg(best.alias("best"))
        .select(*keys, "best.version", "best.source", "best.confidence")
    )


def detect_technologies(files: DataFrame) -> DataFrame:
    return merge_evidence(technology_evidence(files))


def unique_technologies(evidence: DataFrame) -> DataFrame:
    """One row per name, the last one read."""
    last = F.max_by(F.struct("version", "source", "confidence"), "seq")
    return (
        evidence.groupBy("repo_id", "name")
        .agg(last.alias("last"))
        .select("repo_id", "name", "last.version", "last.source", "last.confidence")
    )
