"""TOML manifests: the one place where a Python UDF is needed."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOML_ENTRIES = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("section", "name", "spec")])
)


def _build_udf():
    """The UDF, from functions local to this one: they are sent to the executors by value, so
    the package need not be installed there."""

    def entries(text):
        try:
            data = tomllib.loads(text)
        except Exception:
            return None
        out = []
        project = data.get("project")
        lines = project.get("dependencies") if isinstance(project, dict) else None
        for line in lines if isinstance(lines, list) else []:
            if isinstance(line, str):
                out.append({"section": "project", "name": None, "spec": line})
        crates = data.get("dependencies")
        for name, spec in crates.items() if isinstance(crates, dict) else []:
            version = spec.get("version") if isinstance(spec, dict) else spec
            version = version if isinstance(version, str) else None
            out.append({"section": "crate", "name": name, "spec": version})
        return out

    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(entries)

    return F.pandas_udf(parse, TOML_ENTRIES)


# Requirement lines (section `project`) and crates (section `crate`); null if unreadable.
parse_toml = _build_udf()
