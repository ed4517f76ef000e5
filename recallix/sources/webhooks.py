"""Deliveries of webhooks as a stream of files: signatures are checked, and what is genuine becomes documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIVERY = "id string, source string, event string, signature string, body string"


def hmac_sha256(body: Column, secret: bytes | str) -> Column:
    """HMAC-SHA256 of a text's UTF-8 bytes in lower-case hex."""
    key = secret.encode() if isinstance(secret, str) else secret
    if len(key) > 64:
        raise ValueError("secrets have at most 64 bytes")
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), body.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def refusal(source: Column, body: Column, signature: Column, secrets: dict[str, str]) -> Column:
    """Why a delivery is refused, null where it is genuine: its source has no secret, or its signature is missing, not of
    the source's form, or another than the body's. Signatures of github begin with sha256=, those of notion may."""
    out = F.lit("secret_missing")
    for name, secret in secrets.items():
        given = F.lower(F.regexp_replace(signature, "^sha256=", ""))
        form = F.when(signature.isNull() | (signature == ""), "header_missing")
        form = form.when(~signature.startswith("sha256="), "bad_format") if name == "github" else form
        form = form.when(body.isNull(), "raw_body_missing").when(given != hmac_sha256(body, secret), "mismatch")
        out = F.when(source == name, form).otherwise(out)
    return out


def pretty(body: Column) -> Column:
    """A payload with an indent of two, as it came where it is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return x if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False)
        except ValueError:
            return x

    @F.arrow_udf("string")
    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in bodies.to_pylist()], pa.string())

    return run(body)


def documents(deliveries: DataFrame, secrets: dict[str, str]) -> DataFrame:
    """(id, source, event, content, meta, refused) of deliveries (DELIVERY).

    Of genuine pushes the commits' messages and addresses, of issues and pull requests their action, title and body, of
    other events the payload. refused tells why a delivery was not taken ("no content" for an empty one); its content
    is null.
    """
    path = lambda p: F.get_json_object("body", p)
    body = F.col("body")
    commits = F.from_json(path("$.commits"), "array<struct<message:string,url:string>>")
    push = F.array_join(F.transform(commits, lambda c: F.concat_ws("\n", c["message"], c["url"])), "\n\n")
    titled = lambda what, at: F.concat(F.lit("["), F.coalesce(path("$.action"), F.lit("")), F.lit(what), F.coalesce(path(f"$.{at}.title"), F.lit("")), F.lit("\n"), F.coalesce(path(f"$.{at}.body"), F.lit("")))
    github, event = F.col("source") == "github", F.col("event")
    kind = F.when(~github, "other").when(event.isin("push", "issues", "pull_request"), event).otherwise("other")
    checked = deliveries.withColumn("refused", refusal(F.col("source"), body, F.col("signature"), secrets)).withColumn("_kind", F.when(F.col("refused").isNull(), kind))
    content = F.when(F.col("_kind") == "push", F.coalesce(push, F.lit(""))).when(F.col("_kind") == "issues", titled("] ", "issue")).when(F.col("_kind") == "pull_request", titled("] PR: ", "pull_request"))
    content = content.when(F.col("_kind") == "other", pretty(F.when(F.col("_kind") == "other", body)))
    number = F.when(F.col("_kind") == "issues", path("$.issue.number")).when(F.col("_kind") == "pull_request", path("$.pull_request.number"))
    meta = F.to_json(F.struct(F.concat("source", F.lit("_webhook")).alias("source"), F.when(github, event).alias("event"), F.when(F.col("_kind") != "other", path("$.repository.full_name")).alias("repo"), F.when(F.col("_kind") == "push", path("$.ref")).alias("ref"), number.alias("number")))
    out = checked.withColumn("content", F.nullif(content, F.lit(""))).withColumn("meta", F.when(F.col("refused").isNull(), meta))
    return out.select("id", "source", "event", "content", "meta", F.when(F.col("refused").isNull() & F.col("content").isNull(), "no content").otherwise(F.col("refused")).alias("refused"))


def deliveries(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Deliveries as JSON lines in files that come into a folder, at most so many files a batch. A query's checkpoint
    holds which files it has taken: after a restart none is read twice."""
    return spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", files).json(folder)
