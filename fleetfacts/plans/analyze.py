"""From the file table to all fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetfacts.operators import dbschema, dependencies, imports, inventory, technologies
from fleetfacts.plans.staging import cut_lineage
from fleetfacts.sources.writers import BUCKETS, write_facts

SCHEMA_TABLES = {"schema_tables", "schema_columns", "schema_relationships"}


def analyze_files(
    files: DataFrame, models: DataFrame | None = None, tables: list[str] | None = None
) -> dict[str, DataFrame]:
    """Lazy fact tables of a decoded file table, all or the named ones.

    Each is its own branch of the same scan; filters and columns differ per branch, so they
    are pushed to the scan separately and nothing is cached. `models` are the parsed schema
    models of the files, where they are already there. The plan of the parsers is large, so it
    is built only for tables that need it.
    """
    facts = {
        "file_inventory": lambda: inventory.file_inventory(files),
        "technologies": lambda: technologies.detect_technologies(files),
        "dependencies": lambda: dependencies.extract_dependencies(files),
        "import_edges": lambda: imports.import_edges(files),
    }
    if tables is None or SCHEMA_TABLES & set(tables):
        models = dbschema.schema_models(files) if models is None else models
        found = dbschema.schema_tables(models)
        facts |= {
            "schema_tables": lambda: found.drop("columns"),
            "schema_columns": lambda: dbschema.schema_columns(found),
            "schema_relationships": lambda: dbschema.schema_relationships(models),
        }
    return {name: fact() for name, fact in facts.items() if tables is None or name in tables}


def write_analysis(
    files: DataFrame,
    out_dir: str,
    repos: DataFrame | None = None,
    tables: list[str] | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Replace the facts of the repositories of `files` in every (or each named) fact table.

    Schema sources are parsed once, into a staged table that the three schema tables share.
    """
    repos = files.select("repo_id").distinct() if repos is None else repos
    models = None
    if tables is None or SCHEMA_TABLES & set(tables):
        models = cut_lineage(dbschema.schema_models(files), "models")
    for name, facts in analyze_files(files, models, tables).items():
        write_facts(facts, f"{out_dir.rstrip('/')}/{name}", repos, buckets)
