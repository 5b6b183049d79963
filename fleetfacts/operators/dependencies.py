"""Declared dependencies of the root manifests.

Manifests of all kinds are read in one pass: each becomes an array of (name, version) by its
file name, then rows. There is no shuffle before the reports at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts.functions import text as X
from fleetfacts.operators.technologies import manifests, section, toml_specs

ENTRIES = "array<struct<name: string, version: string>>"


def _entry(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _npm_entries() -> Column:
    """Both sections; a name in both gives two entries."""
    packages = F.concat(
        F.map_entries(section("dependencies")), F.map_entries(section("devDependencies"))
    )
    return F.transform(packages, lambda e: _entry(e["key"], F.nullif(e["value"], F.lit(""))))


def _requirement_entries(lines: Column) -> Column:
    kept = F.filter(lines, lambda l: (l != "") & ~l.startswith("#"))
    return F.transform(kept, lambda l: _entry(X.requirement_name(l), X.requirement_spec(l)))


def _requirements_entries() -> Column:
    return _requirement_entries(X.manifest_lines(F.col("content")))


def _pyproject_entries() -> Column:
    return _requirement_entries(F.transform(toml_specs("project"), lambda e: X.strip(e["spec"])))


def _go_entries() -> Column:
    """`require` blocks and single `require` lines; comment lines are not dependencies.

    The text is cut at each line that opens a block; within a piece, all lines up to the
    closing line are in the block and the rest is outside.
    """
    pieces = F.split(F.col("content"), r"(?dmU)^[^\S\n]*require \([^\S\n]*$")
    empty = F.array().cast("array<string>")

    def lines_of(piece: Column, at: Column) -> Column:
        halves = F.split(piece, r"(?dmU)^[^\S\n]*\)[^\S\n]*$", 2)
        in_block = F.when(at > 0, X.manifest_lines(F.get(halves, F.lit(0))))
        outside = F.when(at == 0, piece).otherwise(F.get(halves, F.lit(1)))
        singles = F.filter(X.manifest_lines(outside), lambda l: l.startswith("require "))
        return F.concat(F.coalesce(in_block, empty), F.coalesce(singles, empty))

    lines = F.flatten(F.transform(pieces, lines_of))
    tokens = F.transform(
        lines, lambda l: F.split(X.strip(F.regexp_replace(l, "^require ", "")), r"(?U)\s+")
    )
    named = F.filter(
        tokens, lambda t: (F.size(t) >= 2) & ~F.get(t, F.lit(0)).startswith("//")
    )
    return F.transform(named, lambda t: _entry(F.get(t, F.lit(0)), F.get(t, F.lit(1))))


def _cargo_entries() -> Column:
    return F.transform(toml_specs("crate"), lambda e: _entry(e["name"], e["spec"]))


# Manifest -> ecosystem and entries.
_MANIFESTS = {
    "package.json": ("npm", _npm_entries),
    "requirements.txt": ("pypi", _requirements_entries),
    "pyproject.toml": ("pypi", _pyproject_entries),
    "go.mod": ("go", _go_entries),
    "Cargo.toml": ("cargo", _cargo_entries),
}


def extract_dependencies(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows of all (or the named) manifests, duplicates kept."""
    names = list(_MANIFESTS) if names is None else names
    entries = F.lit(None).cast(ENTRIES)
    for name in names:
        entries = F.when(F.col("path") == name, _MANIFESTS[name][1]()).otherwise(entries)
    ecosystems = {name: ecosystem for name, (ecosystem, _) in _MANIFESTS.items()}
    rows = manifests(files, names).select("repo_id", "path", F.explode(entries).alias("e"))
    return rows.select(
        "repo_id",
        "e.name",
        "e.version",
        X.lookup(ecosystems, F.col("path")).alias("ecosystem"),
        F.col("path").alias("source"),
    )


def npm_dependencies(files: DataFrame) -> DataFrame:
    return extract_dependencies(files, ["package.json"])


def requirements_dependencies(files: DataFrame) -> DataFrame:
    return extract_dependencies(files, ["requirements.txt"])


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    return extract_dependencies(files, ["pyproject.toml"])


def go_dependencies(files: DataFrame) -> DataFrame:
    return extract_dependencies(files, ["go.mod"])


def cargo_dependencies(files: DataFrame) -> DataFrame:
    return extract_dependencies(files, ["Cargo.toml"])


def dependencies_by_ecosystem(dependencies: DataFrame) -> DataFrame:
    """Dependency list per repository and ecosystem.

    A list comes from at most two root manifests, each of which was one cell of the file
    table, so it is bounded by what one row already held.
    """
    entry = F.struct("name", "version")
    return dependencies.groupBy("repo_id", "ecosystem").agg(
        F.count("*").alias("dependency_count"),
        F.sort_array(F.collect_list(entry)).alias("dependencies"),
    )


def fleet_dependency_versions(dependencies: DataFrame) -> DataFrame:
    """Version drift: how many repositories and constraints each dependency has.

    Rows are made distinct first, so a dependency declared everywhere is reduced before the
    two distinct counts.
    """
    distinct = dependencies.select("ecosystem", "name", "repo_id", "version").distinct()
    return distinct.groupBy("ecosystem", "name").agg(
        F.count_distinct("repo_id").alias("repo_count"),
        F.count_distinct("version").alias("version_count"),
        F.min("version").alias("min_version"),
        F.max("version").alias("max_version"),
    )


def dependency_version_usage(dependencies: DataFrame) -> DataFrame:
    """Repositories per dependency and constraint, one row each instead of a collected set."""
    distinct = dependencies.select("ecosystem", "name", "version", "repo_id").distinct()
    return distinct.groupBy("ecosystem", "name", "version").agg(
        F.count("*").alias("repo_count")
    )
