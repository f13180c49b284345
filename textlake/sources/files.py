"""Files as tables: document folders, markup, catalogs, lexicons, dictionaries, treebanks, sound; and sinks."""

from __future__ import annotations

import io
import re
import wave
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import text as T

#: Folders a scan passes over, besides those that start with a dot.
SKIP = ("node_modules", "__pycache__", "venv", "build", "dist")
SUFFIXES = ("txt", "md", "csv", "html", "htm", "docx", "pdf", "rtf")
MOST_BYTES = 16 * 2**20


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, ext, mtime, size_bytes, content_hash, content) of the files under root. Larger than 16 MiB: no content.
    Spark's reader passes over files of no bytes."""
    glob = "*.{" + ",".join([*suffixes, *[s.upper() for s in suffixes]]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inside = F.regexp_extract("path", f"^.*?{re.escape(root.removeprefix('file:').strip('/'))}(.*)$", 1)
    skipped = inside.rlike(r"/(\.[^/]+|" + "|".join(SKIP) + ")/")
    content = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    return found.filter(~skipped).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size_bytes"), F.sha1(F.coalesce("content", F.lit(b""))).alias("content_hash"), content.alias("content"))


def sniff(raw: bytes) -> str:
    """Text of bytes: UTF-8 if it decodes, else the code page whose text has most letters, digits, spaces and punctuation."""
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    score = lambda t: sum(c.isalnum() or c.isspace() or c in ".,;:!?-()\"'«»" for c in t[:4000]) - 0.5 * sum(a.islower() and b.isupper() for a, b in zip(t[:4000], t[1:4000], strict=False))
    return max((raw.decode(c, "replace") for c in ("cp1251", "koi8-r", "cp866")), key=score)


def docx_text(raw: bytes) -> str:
    """Paragraphs and table rows (cells joined by bars) of a Word file."""
    xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode("utf-8")
    xml = re.sub(r"</w:tc>(?=.*?</w:tr>)", " | ", re.sub(r"</w:tc>\s*</w:tr>|</w:p>(?!\s*</w:tc>)", "\n", xml), flags=re.S)
    text = re.sub(r"<[^>]+>", "", re.sub(r"<w:(?:tab|br)[^>]*/>", " ", xml))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = text.replace(a, b)
    return "\n".join(line.strip() for line in text.splitlines() if line.strip())


def rtf_text(raw: bytes) -> str:
    """Text of a rich-text file: groups of fonts, colours and pictures dropped, escapes resolved."""
    text = raw.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1251"), text)
    text = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\par[d]?\b ?", "\n", text)
    return "\n".join(x.strip() for x in re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text).splitlines() if x.strip())


def extract(files: DataFrame) -> DataFrame:
    """files of scan() -> with text and error: what the suffix's reader gives; trouble is a message, never an exception."""
    readers = {"docx": docx_text, "rtf": rtf_text}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for ext, raw in zip(pdf["ext"], pdf["content"], strict=True):
                try:
                    if raw is None:
                        raise ValueError("file is too large")
                    if ext == "pdf":
                        raise ValueError("no reader for pdf")
                    text = readers.get(ext, sniff)(raw)
                    if not text.strip():
                        raise ValueError("no text")
                    texts.append(text), errors.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None), errors.append(str(e))
            yield pdf.drop(columns="content").assign(text=texts, error=errors)

    out = files.drop("content").withColumns({"text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema
    read = files.mapInPandas(run, out)
    html = F.col("ext").isin("html", "htm")
    return read.withColumns({"title": F.when(html, T.html_title("text")).otherwise(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)), "text": F.when(html, T.html_text("text")).otherwise(F.col("text"))})


def training_corpus(spark: SparkSession, root: str) -> DataFrame:
    """root/<lang>/*.txt -> (lang, text): a language's files in order of their paths, joined by line breaks."""
    rows = spark.read.option("wholetext", True).text(f"{root}/*/*.txt").select("value", F.input_file_name().alias("path"))
    lang = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda s: s["value"])
    return rows.groupBy(lang.alias("lang")).agg(F.array_join(ordered, "\n").alias("text"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV of file and language."""
    return spark.read.schema("file string, language string").csv(path, header=True)


def qrels(spark: SparkSession, path: str, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CSV of query_id;doc_slug;rel -> (judgements with doc_id, unresolved rows); a slug is a file's stem."""
    rows = spark.read.schema("query_id int, doc_slug string, rel int").csv(path, header=True, sep=";")
    slugs = documents.select("doc_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_slug"))
    return rows.join(slugs, "doc_slug").select("query_id", "doc_id", "rel"), rows.join(slugs, "doc_slug", "left_anti")


def catalog(spark: SparkSession, path: str, field: str = "documents") -> DataFrame:
    """A JSON catalog's entries as rows, nested parts as structs."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("d")).select("d.*")


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_no, line_no, value): lines of small files, numbered from 1, files in the order given."""
    parts = [spark.read.option("wholetext", True).text(p).select(F.lit(i).alias("file_no"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value")) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select("file_no", (F.col("n") + 1).alias("line_no"), "value").filter("value <> ''")


def tsv(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Tab-separated columns, `#` comments; missing columns are empty."""
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    return rows.withColumn("p", F.split("value", "\t")).select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def dictionary(lines: DataFrame, longest: int = 3) -> DataFrame:
    """`de; de2 | de3 :: en; en2 | en3` lines -> (key, line, sense, synonym, de): English keys of up to three words."""
    sides = lines.filter(F.col("value").contains("::") & ~F.startswith("value", F.lit("#"))).select(F.xxhash64("value").alias("line"), F.split(F.trim(F.split("value", "::")[0]), r"\s*\|\s*").alias("de"), F.split(F.trim(F.split("value", "::")[1]), r"\s*\|\s*").alias("en"))
    senses = sides.select("line", "de", F.posexplode("en").alias("sense", "e"))
    each = senses.select("line", "sense", F.get("de", F.col("sense")).alias("de"), F.posexplode(F.split("e", r"\s*;\s*")).alias("synonym", "e"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower("e"), r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", ""), r"^to ", ""))
    return each.select(clean.alias("key"), "line", "sense", "synonym", "de").filter((F.col("key") != "") & (F.size(F.split("key", " ")) <= longest))


CONLLU = "sent_id string, text string, tokens array<struct<id int, form string, lemma string, upos string, xpos string, feats string, head int, deprel string, space_after boolean>>"


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """One row per sentence of a treebank. Empty nodes are left out; multi-word lines only tell what follows them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block in pdf["value"]:
                head, tokens, span = {}, [], (0, True)
                for line in block.splitlines():
                    if line.startswith("#"):
                        k, _, v = line[1:].partition("=")
                        head[k.strip()] = v.strip()
                        continue
                    c = line.split("\t")
                    if len(c) != 10 or "." in c[0]:
                        continue
                    after = "SpaceAfter=No" not in c[9]
                    if "-" in c[0]:
                        span = (int(c[0].split("-")[1]), after)
                        continue
                    i = int(c[0])
                    tokens.append({"id": i, "form": c[1], "lemma": c[2], "upos": c[3], "xpos": c[4], "feats": c[5], "head": int(c[6]) if c[6].isdigit() else 0, "deprel": c[7], "space_after": (span[1] if i == span[0] else False) if i <= span[0] else after})
                if tokens:
                    out.append((head.get("sent_id"), head.get("text"), tokens))
            yield pd.DataFrame(out, columns=["sent_id", "text", "tokens"])

    return spark.read.option("lineSep", "\n\n").text(path).mapInPandas(run, CONLLU)


def to_conllu(sentences: DataFrame) -> DataFrame:
    """(value): sentences in ten columns, ready to be written as text."""
    line = lambda t: F.concat_ws("\t", t["id"].cast("string"), t["form"], t["lemma"], t["upos"], t["xpos"], t["feats"], t["head"].cast("string"), t["deprel"], F.lit("_"), F.when(t["space_after"], "_").otherwise("SpaceAfter=No"))
    return sentences.select(F.concat(F.concat_ws("\n", F.concat(F.lit("# sent_id = "), "sent_id"), F.concat(F.lit("# text = "), "text"), F.array_join(F.transform("tokens", line), "\n")), F.lit("\n")).alias("value"))


def is_projective(heads: Column) -> Column:
    """No two arcs cross. heads: each word's head from 1, 0 for the root."""
    arcs = F.transform(heads, lambda h, i: F.struct(F.least(h, i + 1).alias("a"), F.greatest(h, i + 1).alias("b")))
    return ~F.exists(arcs, lambda x: F.exists(arcs, lambda y: (x["a"] < y["a"]) & (y["a"] < x["b"]) & (x["b"] < y["b"])))


def read_wav(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, rate, samples): 16-bit sound, channels averaged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(raw)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"{path}: not 16-bit")
                    data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    out.append((path, w.getframerate(), data.mean(1).astype(np.int16)))
            yield pd.DataFrame(out, columns=["path", "rate", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<smallint>")


def wav_bytes(samples, rate: int) -> bytes:
    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def save_csv(rows: DataFrame, path: str, *order: str, sep: str = ";") -> None:
    """A small result as one ordered CSV file."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, sep=sep)


def save_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_wide(results: DataFrame, path: str) -> None:
    """results(owner, method, predicted) as one row per document, a column per method."""
    save_csv(results.groupBy("owner").pivot("method").agg(F.first("predicted")), path, "owner")
