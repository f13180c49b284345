"""Streams against their batch twins; files read and written."""

import gzip
import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from textlake.sources import files
from textlake.streaming import events as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def as_timestamps(spark):
    return spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_equal_batches(spark, tmp_path):
    batch = as_timestamps(spark)
    batch.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "events"))
    for name, f in (("tumbling", streams.tumbling), ("sliding", streams.sliding), ("sessions", streams.sessions)):
        run(f(streams.read(spark, str(tmp_path / "events"), 10)), name, "complete" if name != "sessions" else "append")
        got, want = spark.table(name), f(batch)
        if name == "sessions":
            assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in want.collect()}
        else:
            assert sorted(tuple(r)[:2] for r in got.collect()) == sorted(tuple(r)[:2] for r in want.collect())
    run(streams.first_of_day(streams.read(spark, str(tmp_path / "events"), 10)), "daily")
    assert spark.table("daily").count() == streams.first_of_day(batch).count()


def test_voice_activity(spark, tmp_path):
    level = [-60.0] * 20 + [-20.0] * 30 + [-60.0] * 60 + [-20.0] * 4 + [-60.0] * 60
    frames = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in enumerate(level)], "stream_id long, seq long, level_db double")
    want = sorted(tuple(r) for r in streams.vad(frames).collect())
    assert [r[2] for r in want if r[0] == 1] == ["start", "end", "start", "drop"]
    for part in range(4):  # batches in order of time
        frames.filter((F.col("seq") >= 45 * part) & (F.col("seq") < 45 * part + 45)).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames"))
    run(streams.vad(stream), "vad")
    assert sorted(tuple(r) for r in spark.table("vad").collect()) == want


def test_countdown(spark):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, "purchase" if i == 1 else "view", 0.0, "") for i in range(6)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    assert [r.left for r in streams.countdown(events, 2).orderBy("event_id").collect()] == [0, 0, 2, 1, 0, 0]


def test_scan_and_extract(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>First &amp; best</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:document>")
    made = {"a.txt": "привет мир".encode("cp1251"), "b.html": b"<title>T</title><p>One</p><script>no</script>", "c.docx": docx.getvalue(), "d.rtf": rb"{\rtf1{\fonttbl x;}Hello\par W\'f6rld}", "e.pdf": b"%PDF", "f.txt": b" \n", "g.xyz": b"no", ".git/h.txt": b"hidden", "sub/i.md": b"\xef\xbb\xbfmark"}
    for name, raw in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.txt", "b.html", "c.docx", "d.rtf", "e.pdf", "f.txt", "i.md"}
    assert rows["a.txt"].text == "привет мир" and rows["b.html"].title == "T" and rows["b.html"].text.endswith("One")
    assert rows["c.docx"].text.splitlines()[0] == "First & best" and rows["d.rtf"].text.startswith("Hello\nW")
    assert rows["e.pdf"].error and rows["f.txt"].error == "no text" and rows["i.md"].text == "mark" and rows["a.txt"].error is None


def test_tables_of_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text("query_id;doc_slug;rel\n1;one;2\n1;gone;1\n")
    docs = spark.createDataFrame([(7, "/x/one.txt")], "doc_id long, path string")
    good, missing = files.qrels(spark, str(tmp_path / "q.csv"), docs)
    assert [tuple(r) for r in good.collect()] == [(1, 7, 2)] and missing.first().doc_slug == "gone"
    (tmp_path / "c.json").write_text('{"documents": [{"id": 1, "source": {"url": "u"}}, {"id": 2, "source": {"url": "v"}}]}')
    assert {(r.id, r.source.url) for r in files.catalog(spark, str(tmp_path / "c.json")).collect()} == {(1, "u"), (2, "v")}
    (tmp_path / "t.tsv").write_text("# c\na\tb\nc\n\n")
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "t.tsv"), "x", "y").orderBy("x").collect()] == [("a", "b"), ("c", "")]
    with gzip.open(tmp_path / "d.gz", "wt") as f:
        f.write("# head\nHaus {n}; Gebäude | laufen :: house [arch.]; building | to run (fast)\n")
    got = {(r.key, r.sense) for r in files.dictionary(spark.read.text(str(tmp_path / "d.gz"))).collect()}
    assert got == {("house", 0), ("building", 0), ("run", 1)}
    for lang in ("de", "ru"):
        (tmp_path / "train" / lang).mkdir(parents=True)
        (tmp_path / "train" / lang / "2.txt").write_text(lang + "2")
        (tmp_path / "train" / lang / "1.txt").write_text(lang + "1")
    assert {r.lang: r.text for r in files.training_corpus(spark, str(tmp_path / "train")).collect()} == {"de": "de1\nde2", "ru": "ru1\nru2"}
    files.save_csv(good, str(tmp_path / "out"), "query_id")
    assert spark.read.csv(str(tmp_path / "out"), header=True, sep=";").count() == 1


def test_treebank_and_sound(spark, tmp_path):
    text = "# sent_id = 1\n# text = Don't go\n1-2\tDon't\t_\t_\t_\t_\t_\t_\t_\t_\n1\tDo\tdo\tAUX\tVB\tA=1|B=2\t3\taux\t_\t_\n2\tn't\tnot\tPART\tRB\t_\t3\tadvmod\t_\t_\n2.1\tx\tx\t_\t_\t_\t_\t_\t_\t_\n3\tgo\tgo\tVERB\tVB\t_\t0\troot\t_\tSpaceAfter=No\n\n"
    (tmp_path / "a.conllu").write_text(text)
    row = files.conllu(spark, str(tmp_path / "a.conllu")).first()
    assert [(t.form, t["head"], t.space_after) for t in row.tokens] == [("Do", 3, False), ("n't", 3, True), ("go", 0, False)]
    out = files.to_conllu(files.conllu(spark, str(tmp_path / "a.conllu"))).first().value
    assert "3\tgo\tgo\tVERB\tVB\t_\t0\troot\t_\tSpaceAfter=No" in out
    heads = spark.createDataFrame([([2, 0, 2],), ([3, 4, 0, 3],)], "h array<int>")
    assert [r[0] for r in heads.select(files.is_projective(F.col("h"))).collect()] == [True, False]
    samples = np.array([0, 100, -100, 32767], np.int16)
    wavs = spark.createDataFrame([("a.wav", bytearray(files.wav_bytes(samples, 8000)))], "path string, content binary")
    got = files.read_wav(wavs).first()
    assert got.rate == 8000 and list(got.samples) == samples.tolist()
