from pyspark.sql import functions as F

from quarry.sources import readers, writers


def put(folder, name, content, encoding="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content.encode(encoding))
    return str(folder)


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def test_documents(spark, tmp_path):
    p = put(tmp_path / "d", "a", "<DOC>\n<DOCNO> D1 </DOCNO>\n<TEXT>\nfirst é\n</TEXT>\n<TEXT>second</TEXT></DOC><DOC><DOCNO>D2</DOCNO></DOC>", "latin-1")
    put(tmp_path / "d", "readme", "<DOC><DOCNO>X</DOCNO><TEXT>no</TEXT></DOC>")
    assert got(readers.documents(spark, p)) == [("D1", "second"), ("D2", "")]
    whole = {r[0]: r[1].split() for r in readers.documents(spark, p, blocks="all").collect()}
    assert whole["D1"] == ["first", "é", "second"]


def test_word_files(spark, tmp_path):
    stems = put(tmp_path / "s", "x", "root | words\nrun | running runs\nbad line\n")
    assert ("runs", "run") in got(readers.stem_classes(spark, stems))
    assert got(readers.word_list(spark, put(tmp_path / "w", "x", "The\nof\nthe\n"))) == [("of",), ("the",)]
    assert got(readers.topics(spark, put(tmp_path / "q", "x", "51.   airbus subsidies\nnonsense\n"))) == [(51, "airbus subsidies")]


def test_judgements_and_runs(spark, tmp_path):
    q = put(tmp_path / "q", "x", "1 me d1 0\n1 me d2 1\n1 me d1 2\nbroken\n")
    assert got(readers.judgements(spark, q), "doc_id") == [("1", "d1", 2), ("1", "d2", 1)]
    ranked = spark.createDataFrame([("1", "d1", 1, 2.5), ("1", "d2", 2, 1.5)], "query_id string, doc_id string, rank int, score double")
    writers.write_run(ranked, str(tmp_path / "run"))
    assert got(readers.run(spark, str(tmp_path / "run")).select("query_id", "doc_id", "rank", "score"), "rank") == got(ranked, "rank")
    writers.append_judgements(spark.createDataFrame([("1", "d1", 1)], "query_id string, doc_id string, grade int"), str(tmp_path / "j"))
    assert got(readers.judgements(spark, str(tmp_path / "j"))) == [("1", "d1", 1)]


def test_links(spark, tmp_path):
    a = readers.adjacency(spark, put(tmp_path / "a", "x", "p q r q \nz\n\n"))
    assert got(readers.edges(a), "src", "dst") == [("p", "q"), ("p", "q"), ("p", "r")]
    assert got(readers.edges(a, links_in=True), "src")[0] == ("q", "p")
    writers.write_adjacency(readers.edges(a), str(tmp_path / "b"))
    assert got(readers.adjacency(spark, str(tmp_path / "b"))) == [("p", ["q", "q", "r"])]
    assert got(readers.link_map(spark, put(tmp_path / "m", "x", "k: a, b\nl: \n"))) == [("k", ["a", "b"]), ("l", [])]
    links = readers.document_links(spark, put(tmp_path / "l", "x", "Inlinks:a b, Outlinks:c d"))
    assert got(links) == [("x", ["a", "b"], ["c", "d"])]


def test_mail(spark, tmp_path):
    mail = "Subject: x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nHello, you!\n--B\nContent-Type: text/html\n\n<p>Win <b>cash</b></p>\n--B--\n"
    assert got(readers.mails(spark, put(tmp_path / "m", "inmail.1", mail)))[0] == ("inmail.1", "Hello you Win cash")
    assert got(readers.mail_labels(spark, put(tmp_path / "i", "x", "spam ../data/inmail.1\nHAM ../data/inmail.2\n"))) == [("inmail.1", "spam"), ("inmail.2", "ham")]


def test_reports(spark, tmp_path):
    m = readers.metrics(spark, put(tmp_path / "r", "x", "Precision@5: 0.4\nR-Precision: 0.25\nnoise\n"))
    assert got(m, "value") == [("R-Precision", None, 0.25), ("Precision", 5, 0.4)]
    c = readers.crawled(spark, put(tmp_path / "c", "x", "<DOC><DOCNO>http://a</DOCNO><HEAD>T</HEAD><TEXT>a\nb</TEXT></DOC>"))
    assert c.select("url", "title", "text").first() == ("http://a", "T", "a\nb")
    ranks = spark.createDataFrame([("p", 0.25, 1, 2), ("q", 0.5, 3, 4)], "page string, rank double, n_out int, n_in int")
    writers.write_top_pages(ranks, str(tmp_path / "t"))
    assert [r[0].split() for r in spark.read.text(str(tmp_path / "t")).collect()] == [["q", "0.5000000000000000", "3", "4"], ["p", "0.2500000000000000", "1", "2"]]
    writers.write_predictions(ranks.select(F.col("page").alias("id"), F.col("rank").alias("probability")), str(tmp_path / "p"))
    assert writers.folder_size(spark, str(tmp_path / "p"))[0] >= 1


def test_split_agrees(spark):
    rows = spark.range(2000).withColumn("s", readers.split_by_hash(F.col("id")))
    n = rows.where("s = 'train'").count()
    assert 1500 < n < 1700 and n == rows.where("s = 'train'").count()
