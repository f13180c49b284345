"""What leaves and enters as text: lexicon files, wrapped paragraphs, tables of fixed width, trees by indents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions.text import let

COLUMNS = ("en", "pos", "de", "gender", "plural", "extra", "domain")
GENERAL = "general"


def lexicon_lines(lexicon: DataFrame) -> DataFrame:
    """(value): a lexicon as tab-separated lines under a comment with their names, by lower en, pos and rank; nulls are empty,
    tabs and line ends within a cell spaces. The order is Spark's global one, so it may be written as text."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in COLUMNS]
    rows = lexicon.select(F.lit(1).alias("_part"), F.lower("en").alias("_en"), F.col("pos").alias("_pos"), F.col("rank").alias("_rank"), F.concat_ws("\t", *cells).alias("value"))
    head = lexicon.sparkSession.createDataFrame([(0, "", "", 0, "# " + "\t".join(COLUMNS))], rows.schema)
    return head.union(rows).orderBy("_part", "_en", "_pos", "_rank", "value").select("value")


def imported(spark: SparkSession, path: str, lexicon: DataFrame, kinds: list[str]) -> DataFrame:
    """Entries (COLUMNS, rank, source) of a tab-separated file that the lexicon does not have: of en (whatever its case), pos,
    de and domain. Comments, lines of fewer than three cells, without en or de, and of other parts of speech than `kinds`
    are passed over; of equal lines one counts. Ranks go on from the lexicon's."""
    cells = F.transform(F.split("value", "\t"), lambda c: F.trim(c))
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(cells.alias("c")).filter(F.size("c") >= 3)
    rows = rows.select(*(F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(COLUMNS)))
    rows = rows.withColumns({"pos": F.upper("pos"), "domain": F.when(F.col("domain") == "", GENERAL).otherwise(F.col("domain"))})
    good = rows.filter((F.col("en") != "") & (F.col("de") != "") & F.col("pos").isin(*kinds, "\0"))
    same = ("_en", "pos", "de", "domain")
    new = good.withColumn("_en", F.lower("en")).groupBy(*same).agg(F.min(F.struct("en", "gender", "plural", "extra")).alias("x"))
    old = lexicon.withColumns({"_en": F.lower("en"), "domain": F.when(F.coalesce("domain", F.lit("")) == "", GENERAL).otherwise(F.col("domain"))})
    last = old.groupBy("_en", "pos").agg(F.max("rank").alias("_last"))
    left = new.join(old.select(*same).distinct(), list(same), "left_anti").join(last, ["_en", "pos"], "left")
    rank = F.row_number().over(Window.partitionBy("_en", "pos").orderBy("de", "domain")) + F.coalesce("_last", F.lit(-1))
    return left.withColumn("rank", rank).select("x.en", "pos", "de", "x.gender", "x.plural", "x.extra", "domain", "rank", F.lit("user").alias("source"))


def wrapped(text: Column, width: int, indent: str = "") -> Column:
    """Lines of words, as many to a line as `width` characters hold, the indent with them; a longer word is a line of its own.
    No words are one empty line."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def step(state: Column, word: Column) -> Column:
        full = (state["line"] != "") & (F.length(state["line"]) + 1 + F.length(word) > width - len(indent))
        done = F.when(full, F.array_append(state["done"], F.concat(F.lit(indent), state["line"]))).otherwise(state["done"])
        line = F.when(full | (state["line"] == ""), word).otherwise(F.concat_ws(" ", state["line"], word))
        return F.struct(done.alias("done"), line.alias("line"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    return F.aggregate(words, start, step, lambda s: F.when((s["line"] == "") & (F.size(s["done"]) > 0), s["done"]).otherwise(F.array_append(s["done"], F.concat(F.lit(indent), s["line"]))))


def table_line(cells: list[Column], widths: list[int]) -> Column:
    """Cells side by side, each padded to its width, or cut to it with an ellipsis; line ends within are spaces."""
    def fit(cell: Column, width: int) -> Column:
        flat = F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" "))
        return F.when(F.length(flat) <= width, F.rpad(flat, width, " ")).otherwise(F.concat(F.substring(flat, 1, width - 1), F.lit("…")))

    return F.rtrim(F.concat_ws(" | ", *(fit(c, w) for c, w in zip(cells, widths, strict=True))))


def encoded(text: Column, encoding: str) -> Column:
    """Bytes of a text with line ends of two characters: `utf-16` with its mark, or `utf-8-sig`."""
    lines = F.regexp_replace(text, r"\r?\n", "\r\n")
    return let(lines, lambda t: F.encode(t, "UTF-16") if encoding == "utf-16" else F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(t, "UTF-8")))


def most_common(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, value, n): the commonest value of each group, of equal ones the first by `order`; nulls don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), "_first", F.col(value).alias("v"))).alias("x"))
    return best.select(by, F.col("x.v").alias(value), (-F.col("x.m")).alias("n"))


def tree_lines(tree: DataFrame) -> DataFrame:
    """tree(doc_id, head, parent, text, kind, freq, weight) of keywordtree.tree() -> (doc_id, text): a line a keyword, four
    spaces for each step down, heads by falling weight, the loose ones in a last line."""
    plain = tree.filter("kind <> 'loose'")
    top = F.when(F.col("head").isNull(), F.col("text")).otherwise(F.col("head"))
    weight = plain.filter("head IS NULL").select("doc_id", F.col("text").alias("_top"), F.col("weight").alias("_weight"))
    up = plain.select(F.col("doc_id").alias("_doc"), F.col("head").alias("_h"), F.col("text").alias("_t"), F.col("weight").alias("_w"), F.col("parent").alias("_up"))
    rows = plain.withColumn("_top", top).join(weight, ["doc_id", "_top"])
    rows = rows.join(up, (F.col("doc_id") == F.col("_doc")) & (F.col("head") == F.col("_h")) & (F.col("parent") == F.col("_t")), "left")
    depth = F.when(F.col("head").isNull(), 0).when(F.col("parent").isNull(), 1).when(F.col("_up").isNull(), 2).otherwise(3)
    first = F.when(depth == 0, F.struct(F.lit(float("-inf")).alias("w"), F.lit("").alias("t"))).when(depth == 1, F.struct((-F.col("weight")).alias("w"), F.col("text").alias("t"))).otherwise(F.struct((-F.col("_w")).alias("w"), F.col("parent").alias("t")))
    key = F.struct((-F.col("_weight")).alias("a"), F.col("_top").alias("b"), first.alias("c"), depth.alias("d"), (-F.col("weight")).alias("e"), F.concat(F.repeat(F.lit("    "), depth + 1), "text").alias("line"))
    lines = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]), "\n").alias("lines"))
    loose = tree.filter("kind = 'loose'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "text"))).alias("ls"))
    both = lines.join(loose, "doc_id", "full")
    rest = F.when(F.col("ls").isNotNull(), F.array_join(F.transform("ls", lambda x: x["text"]), ", "))
    return both.select("doc_id", F.concat_ws("\n", "lines", rest).alias("text"))


def kept(saved: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Saved rows whose key is not among the removed ones'."""
    return saved.join(removed.select(key).distinct(), key, "left_anti")
