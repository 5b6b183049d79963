"""Private keys are covered whole, not by their first line only."""

import base64
import random

from pyspark.sql import functions as F

from fleetfacts.llm import secret_scan

RULE = next(r for r in secret_scan.MORE_RULES if r.kind == "private_key")
BODY = base64.b64encode(random.Random(1).randbytes(601)).decode()
LINES = [BODY[i : i + 64] for i in range(0, len(BODY), 64)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def test_no_key_material_is_left_after_redact(spark):
    long = base64.b64encode(random.Random(2).randbytes(30_000)).decode()
    texts = [
        f"before\n{BEGIN}\n" + "\n".join(LINES) + f"\n{END}\nafter it",
        f"before\r\n{BEGIN}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0A\r\n\r\n" + "\r\n".join(LINES) + f"\r\n{END}\r\nafter it",
        'before {"key": "' + BEGIN + "\\n" + "\\n".join(LINES) + "\\n" + END + '\\n"} after it',
        f"before\n  {BEGIN}\n" + "\n".join(f"  {x}" for x in LINES) + "\n\nafter it",
        f"before {BEGIN}\n" + "\n".join(LINES),
        f"before {BEGIN}" + BODY + f"{END} after it",
        f"before {BEGIN}\n" + "\n".join(LINES) + f"\n{BEGIN}\n" + "\n".join(LINES) + f"\n{END}\nafter it",
        "before -----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 1\n\n" + "\n".join(LINES) + "\n=aB3d\n-----END PGP PRIVATE KEY BLOCK----- after it",
        f"before\n{BEGIN}\n" + long + f"\n{END}\nafter it",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.find_secrets(rows).select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("clean"))
    at_once = {r["doc_id"]: r["clean"] for r in secret_scan.find_secrets(rows, mask="[SECRET]").collect()}
    for row in found.collect():
        clean = row["clean"]
        assert at_once[row["doc_id"]] == clean
        assert "PRIVATE KEY" not in clean and clean.startswith("before") and "[SECRET]" in clean
        source = texts[row["doc_id"]]
        assert clean.endswith("after it") or not source.endswith("after it")
        assert not any(source[i : i + 12] in clean for line in LINES for i in [source.find(line)] if i >= 0)
        assert LINES[-1] not in clean and long[:40] not in clean and long[-40:] not in clean


def test_header_alone_leaves_the_prose_after_it():
    text = f"A key file starts with the line {BEGIN} and goes on.\nNote: keep it safe.\nThanks\n" + BODY
    match = RULE.compiled().search(text)
    assert match.group() == BEGIN
    assert secret_scan.trigram_query(RULE) != secret_scan.ALL


def test_many_headers_without_end_take_linear_time():
    text = (BEGIN + "\n- x ") * 20_000
    assert sum(1 for _ in RULE.compiled().finditer(text)) == 20_000
