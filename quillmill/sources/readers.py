"""Sources: Markdown trees, paged exports, JSON jobs and decisions, ZIP snapshots, and the sinks that go with them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.session import filled_frames

#: Names that no managed document lies under.
UNMANAGED = r"(^|/)(\.obsidian|\.state|\.git|_attachments)(/|$)"


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, modified) of all *.md files below root, without unmanaged folders; path is relative, '/'-separated."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    rel = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    cut = len(root.rstrip("/")) + 2
    return df.select(rel.substr(F.lit(cut), F.length(rel)).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified")).where(~F.col("path").rlike(UNMANAGED))


def documents(tree: DataFrame) -> DataFrame:
    """markdown_tree() with header fields, title, times and guid. Title: first heading, else file name; updated defaults to created."""
    h = T.header_fields(F.col("text"))
    df = tree.withColumn("fields", h)
    created = F.try_to_timestamp(F.col("fields")["created"])
    return df.withColumns(
        {
            "guid": F.coalesce(F.col("fields")["source_guid"], F.col("fields")["uid"]),
            "title": F.coalesce(T.first_heading(T.body_of(F.col("text"))), F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.md$", "")),
            "domain": F.col("fields")["domain"],
            "created": created,
            "updated": F.coalesce(F.try_to_timestamp(F.col("fields")["updated"]), created),
        }
    )


def write_documents(docs: DataFrame, root: str) -> None:
    """Partitioned by domain and month: each write replaces only the partitions that it holds."""
    out = docs.withColumn("month", T.month_folder(F.col("created")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "month").parquet(root)


def export_markdown(docs: DataFrame, root: str) -> DataFrame:
    """Write docs (path, text) as files below root, only where the content differs; (path, written) for each.

    Files are written by the tasks through the local or mounted file system, beside the target and then renamed.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        base = os.path.realpath(root)
        for pdf in batches:
            done = []
            for path, text in zip(pdf["path"], pdf["text"]):
                full = os.path.realpath(os.path.join(base, path))
                if not full.startswith(base + os.sep):
                    raise ValueError(f"path leaves the root: {path}")
                data = text.encode()
                same = os.path.exists(full) and open(full, "rb").read() == data
                if not same:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    temp = f"{full}.{uuid.uuid4().hex}"
                    with open(temp, "wb") as f:
                        f.write(data)
                    os.replace(temp, full)
                done.append(not same)
            yield pd.DataFrame({"path": pdf["path"], "written": done})

    return docs.select("path", "text").mapInPandas(filled_frames(write), "path string, written boolean")


def page_ranges(total: int, size: int = 250) -> list[tuple[int, int]]:
    """(offset, count) of each page: how a live service is read in parallel partitions."""
    return [(i, min(size, total - i)) for i in range(0, max(0, total), size)]


def strict_json(payload: str) -> dict:
    """JSON whose objects have no repeated key."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ValueError(f"repeated key in {keys}")
        return dict(items)

    return json.loads(payload, object_pairs_hook=pairs)


def load_job(payload: str, known: list[str]) -> dict:
    """since, until, selection_mode, domains {name: keywords}, aliases; ordered, without repeated keywords.

    since < until; domains are known and not empty; aliases belong to keywords of the job.
    """
    job = strict_json(payload)
    if unknown := set(job) - {"since", "until", "selection_mode", "domains", "aliases"}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    since, until = pd.Timestamp(job["since"]), pd.Timestamp(job["until"])
    if not since < until:
        raise ValueError("since must be before until")
    mode = job.get("selection_mode", "domain_gate")
    if mode not in ("domain_gate", "keyword_union"):
        raise ValueError(f"unknown selection_mode {mode}")
    domains = {d: list(dict.fromkeys(k.strip() for k in v["keywords"] if k.strip())) for d, v in job["domains"].items()}
    if not domains or any(not k for k in domains.values()):
        raise ValueError("each job needs domains with keywords")
    if mode == "domain_gate" and (bad := set(domains) - set(known)):
        raise ValueError(f"unknown domains: {sorted(bad)}")
    words = {w for k in domains.values() for w in k}
    aliases = job.get("aliases", {})
    if bad := set(aliases) - words:
        raise ValueError(f"aliases of no keyword: {sorted(bad)}")
    return {"since": since.date(), "until": until.date(), "selection_mode": mode, "domains": domains, "aliases": aliases}


def job_id(job: dict) -> str:
    """16 hexadecimal digits; the order of the domains does not count."""
    text = json.dumps({**job, "since": str(job["since"]), "until": str(job["until"])}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def decisions(spark: SparkSession, payload: str) -> dict[str, DataFrame]:
    """moves (path, domain), trash (path), links (a, b) of a review, from strict JSON."""
    data = strict_json(payload)
    if set(data) != {"moves", "trash", "links"}:
        raise ValueError("a review has moves, trash and links")
    return {
        "moves": spark.createDataFrame(list(data["moves"].items()), "path string, domain string"),
        "trash": spark.createDataFrame([(p,) for p in data["trash"]], "path string"),
        "links": spark.createDataFrame([(a, b) for a, bs in data["links"].items() for b in bs], "a string, b string"),
    }


def zip_members(spark: SparkSession, glob: str) -> DataFrame:
    """(archive, path, size, sha, problem) of each member of ZIP files; problem names repeated or unsafe member names."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                rows, seen = [], set()
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        unsafe = m.filename.startswith("/") or ".." in m.filename.split("/") or "\\" in m.filename
                        problem = "unsafe" if unsafe else "repeated" if m.filename in seen else None
                        seen.add(m.filename)
                        h = hashlib.sha256()
                        with z.open(m) as f:
                            while part := f.read(1 << 20):
                                h.update(part)
                        rows.append((archive, m.filename, m.file_size, h.hexdigest(), problem))
                yield pd.DataFrame(rows, columns=["archive", "path", "size", "sha", "problem"])

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(filled_frames(scan), "archive string, path string, size long, sha string, problem string")


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha) of the files below root; hashed on the executors."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))
