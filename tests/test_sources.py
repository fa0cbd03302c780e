"""Archives, mails, delimited files and the stream."""

import io
import tarfile
import zipfile
from datetime import datetime

import pytest

from pricemap.sources import files, mail, versioned
from pricemap.streaming import ingest
from pricemap.streaming import participations as streamed

MAIL = (
    b"From: Jo <Jo@Acme.com.br>\r\nTo: a@x.mil.br, B <b@y.com>\r\nSubject: =?utf-8?q?Preg=C3=A3o_12/2024?=\r\nDate: Tue, 23 Jan 2024 11:37:00 -0300\r\nMessage-ID: <1@acme>\r\nMIME-Version: 1.0\r\n"
    b'Content-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Segue proposta</p>\r\n--q\r\nContent-Type: application/pdf\r\n'
    b'Content-Disposition: attachment; filename="cotacao.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nJVBERg==\r\n--q--\r\n'
)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("b/x.eml", "a.pdf", "c.txt", "d.csv"):
            z.writestr(name, MAIL)
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        for name in ("z.eml", "y.png"):
            info = tarfile.TarInfo(name)
            info.size = len(MAIL)
            t.addfile(info, io.BytesIO(MAIL))
    got = files.read_archives(spark, str(tmp_path)).orderBy("archive", "seq").collect()
    assert [(r.archive, r.name, r.kind) for r in got] == [("a.zip", "a.pdf", "file"), ("a.zip", "x.eml", "mail"), ("b.tgz", "z.eml", "mail"), ("b.tgz", "y.png", "file")]


def test_mail(spark):
    df = spark.createDataFrame([("m.eml", bytearray(MAIL)), ("bad.eml", bytearray(b"no headers at all"))], "name string, content binary")
    got = {r.source_file: r for r in mail.parse_messages(df).collect()}
    m = got["m.eml"]
    assert (m.subject, m.from_email, m.message_id, m.body, m.has_attachment, m.is_mdn) == ("Pregão 12/2024", "jo@acme.com.br", "<1@acme>", "Segue proposta", True, False)
    assert m.sent_at == datetime(2024, 1, 23, 14, 37) and [p.email for p in m.recipients] == ["a@x.mil.br", "b@y.com"]
    assert got["bad.eml"].sent_at is None and len(got["bad.eml"].message_id) == 32
    names = mail.message_attachments(mail.parse_messages(df)).select("name", "pos").collect()
    assert [(r.name, r.pos) for r in names] == [("cotacao.pdf", 0)]
    batch = mail.parse_messages(df).selectExpr("*", "1 AS batch_id", "CASE source_file WHEN 'm.eml' THEN 1 ELSE 2 END AS ingest_seq")
    assert {r.process_number for r in mail.assign_process(batch).collect()} == {"12/2024"}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Item;Descrição;Valor\n1;"bomba";2,50\n')
    got = files.read_quote_csv(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [r.text for r in got] == ["Item", "Descrição", "Valor", "1", "bomba", "2,50"]


def test_master_list(spark):
    df = spark.createDataFrame([("1", "bomba")], "`Nº Item` string, `Descrição do material` string")
    r = files.read_master(df).first()
    assert (r.item_no, r.description, r.material_code) == ("1", "bomba", None)
    assert files.read_master(df.toDF("x", "y")).count() == 0


def test_stream_keeps_each_message_once(spark, tmp_path):
    schema = "process_id string, message_id string, ingest_seq long, sent_at timestamp, from_email string, type string"
    rows = [("p", f"m{k % 3}", k, datetime(2024, 5, 1, 0, k), "a@b.c", "duvida") for k in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_versioned_table(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(rows, "file_id string, n int, seq long")
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ["file_id"], buckets=4)
    assert table.read() is None and table.delete(df(("a", 1, 1))) == 0
    assert table.replace(df(("a", 1, 1), ("a", 2, 2), ("b", 3, 3), (None, 9, 9))) == 1
    assert table.replace(df(("a", 5, 4))) == 2
    # a writer that fails before its commit changes nothing
    with pytest.raises(Exception, match="broken"):
        table.change(df(("b", 7, 7)), lambda old, new: new.selectExpr("file_id", "CAST(raise_error('broken') AS INT) AS n", "seq"))
    assert {(r.file_id, r.n) for r in table.read().collect()} == {("a", 5), ("b", 3), (None, 9)}
    assert {(r.file_id, r.n) for r in table.read(1).collect()} == {("a", 1), ("a", 2), ("b", 3), (None, 9)}
    # of two writers that built on one version, the second fails and nothing of it is seen
    with pytest.raises(versioned.Conflict):
        table._publish(table.commit() | {"folders": {}})
    assert len(table.read().collect()) == 3
    assert table.upsert(df(("a", 6, 9), ("c", 1, 1)), {"n": "last"}) == 3
    assert {(r.file_id, r.n) for r in table.read().collect()} == {("a", 6), ("b", 3), ("c", 1), (None, 9)}
    assert table.delete(df(("b", 0, 0))) == 4 and {r.file_id for r in table.read().collect()} == {"a", "c", None}
    assert table.replace(df().limit(0)) == 4
    assert table.vacuum() > 0 and {r.file_id for r in table.read().collect()} == {"a", "c", None} and table.versions() == [4]


def test_extraction_goes_on_where_a_run_failed(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ["file_id"], buckets=4)
    files_of = lambda *rows: spark.createDataFrame(rows, "file_id string, version string")
    seen = []

    def extract(missing):
        seen.append(sorted(r.file_id for r in missing.collect()))
        return missing.selectExpr("file_id", f"{len(seen)} AS run")

    got = versioned.extract_incrementally(table, files_of(("a", "1"), ("b", "1")), extract, "5")
    assert {(r.file_id, r.run) for r in got.collect()} == {("a", 1), ("b", 1)}
    got = versioned.extract_incrementally(table, files_of(("a", "1"), ("b", "2"), ("c", "1")), extract, "5")
    assert {(r.file_id, r.version, r.run) for r in got.collect()} == {("a", "1", 1), ("b", "2", 2), ("c", "1", 2)}
    assert seen == [["a", "b"], ["b", "c"]]


def test_stream_of_participations_with_repeats_and_late_first_arrivals(spark, tmp_path):
    schema = "process_id string, message_id string, ingest_seq long, sent_at timestamp, from_email string, type string"
    at = lambda k: datetime(2024, 5, 1, 0, k)
    batches = [
        [("p", "m1", 5, at(5), "a@b.c", "pedido_orcamento"), ("p", "m2", 6, at(6), "a@b.c", "orcamento_recebido"), ("p", "m1", 7, at(7), "x@b.c", "pedido_orcamento")],
        [("p", "m1", 2, at(9), "x@b.c", "duvida"), ("p", "m3", 3, None, "a@b.c", "pedido_orcamento")],  # m1 came first from another sender
        [("p", "m4", 1, at(1), "a@b.c", "declinio"), ("p", "m2", 6, at(6), "a@b.c", "orcamento_recebido")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    streamed.follow_participations(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.from_email: r for r in streamed.latest_participations(spark, str(tmp_path / "out")).collect()}
    a, x = got["a@b.c"], got["x@b.c"]
    assert (a.asked, a.sent_quote, a.declined, a.requested_at, a.first_reply_at) == (True, True, True, None, at(1))
    assert (x.asked, x.sent_quote, x.declined, x.requested_at, x.first_reply_at) == (False, False, False, None, at(9))


def test_work_paths_carry_their_scheme(spark, tmp_path):
    from pricemap import work

    assert work.qualified(spark, str(tmp_path / "x")) == f"file:{tmp_path}/x"  # a bare path
    made = work.new_folder(spark, "t")
    assert made.startswith("file:/") and work.shared_folder(spark) == work.shared_folder(spark)
    where, inner = work.filesystem(made)
    assert where.type_name == "local" and inner.startswith("/") and "/t-" in inner


def test_changed_participations_tell_senders_that_lost_their_messages(spark, tmp_path):
    at = lambda k: datetime(2024, 5, 1, 0, k)
    schema = "process_id string, message_id string, ingest_seq long, from_email string, type string, sent_at timestamp, batch long"
    rows = [("p", "m1", 5, "a", "pedido_orcamento", at(5), 0), ("p", "m2", 6, "b", "declinio", at(6), 0), ("p", "m1", 2, "x", "duvida", at(9), 1), ("p", "m1", 1, "y", None, None, 2)]
    arrivals = spark.createDataFrame(rows, schema)
    got = lambda number: {r.from_email: (r.n_messages, r.asked, r.requested_at, r.first_reply_at) for r in streamed.changed_participations(arrivals, number).collect()}
    assert got(0) == {"a": (1, True, at(5), None), "b": (1, False, None, at(6))}
    # nothing of b's has changed
    assert got(1) == {"a": (0, None, None, None), "x": (1, False, None, at(9))}
    assert got(2) == {"a": (0, None, None, None), "x": (0, None, None, None), "y": (1, None, None, None)}
    # state is Spark's own: no Python runs for a message
    stream = spark.readStream.schema(arrivals.drop("batch").schema).parquet(str(tmp_path))
    assert "StateInPandas" not in streamed.first_arrivals(stream)._jdf.queryExecution().analyzed().toString()
