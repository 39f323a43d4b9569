import gzip
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import raster as R
from folio.operators import blocks, crf, raster, targets
from folio.plans import pipelines
from folio.sources import documents, external, files, sinks, tfrecord
from folio.streaming import word_counts

LXML = """<DOCUMENT>{}</DOCUMENT>"""
PAGE = """<PAGE number="{n}" width="100" height="80"><BLOCK>{lines}</BLOCK></PAGE>"""


def token(text, x, y, **more):
    extra = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in more.items())
    return f'<TOKEN x="{x}" y="{y}" width="{8 * len(text)}" height="10"{extra}>{text}</TOKEN>'


def layout(*pages):
    return LXML.format("".join(PAGE.format(n=k + 1, lines="".join(f"<TEXT>{''.join(token(w, 10 + 20 * i, 10 + 20 * n) for i, w in enumerate(line.split()))}</TEXT>" for n, line in enumerate(p))) for k, p in enumerate(pages))).encode()


def file_rows(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_layout_documents(spark):
    one = LXML.format(PAGE.format(n=1, lines=f"<TEXT>{token('Hi', 10, 20, font_size=40, font_name='f', tag='b-x', **{'crf-tag': 'y'})}</TEXT>")).encode()
    r = documents.tokens(file_rows(spark, ("a.lxml", one))).first()
    assert (r.text, r.x_raw, tuple(r.bbox), r.font_size, r.font_name, r.tags, r.page_width, r.block_idx) == ("Hi", "10", (10, 20, 16, 10), 40, "f", {"": "b-x", "crf-tag": "y"}, 100, 0)
    many = documents.tokens(file_rows(spark, ("b.lxml", layout(["a b"], ["c"], ["d"])), ("bad.lxml", b"<x")), pages=(2, 3)).collect()
    assert [(x.page_idx, x.text) for x in many if x.error is None] == [(1, "c"), (2, "d")] and [x.doc_id for x in many if x.error] == ["bad.lxml"]


def test_svg_pages_round_trip(spark):
    rows = documents.tokens(file_rows(spark, ("a.lxml", layout(["a b", "c"], ["d"]))))
    pages = documents.svg_pages(rows).withColumn("content", F.encode("svg", "UTF-8"))
    zipped = sinks.zipped_pages(pages, ".svg").first()["zip"]
    with zipfile.ZipFile(io.BytesIO(zipped)) as z:
        assert z.namelist() == ["page-1.svg", "page-2.svg"]
    back = documents.tokens(file_rows(spark, ("a.svg.zip", zipped)))
    key = ["page_idx", "line_idx", "token_idx", "text"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, rows.select(*key).collect()))
    styled = documents.styled_svg('<svg><g class="line"><text class="b">x</text></g></svg>')
    assert "<title>b</title>" in styled and "text.b {" in styled


def test_lists_and_contents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, data in (("a.xml", b"<a/>"), ("b.xml.gz", gzip.compress(b"<b/>"))):
        (tmp_path / "in" / n).write_bytes(data)
    (tmp_path / "list.tsv").write_text(f"source_url\txml_url\n{tmp_path}/in/a.xml\tx\n")
    pairs = files.listed_pairs(spark, f"{tmp_path}/list.tsv", 5)
    assert bytes(files.contents(pairs, "source_url").first().content) == b"<a/>"
    (tmp_path / "plain.txt").write_text("u1\n\nu2\n")
    assert [r.url for r in files.listed_files(spark, f"{tmp_path}/plain.txt").collect()] == ["u1", "u2"]
    wanted = spark.createDataFrame([(f"{tmp_path}/in/a.xml",), (f"{tmp_path}/in/b.xml",), (f"{tmp_path}/in/none",)], "path string")
    got = {r.path.rsplit("/", 1)[1]: r.content and bytes(r.content) for r in files.with_gz_fallback(wanted).collect()}
    assert got == {"a.xml": b"<a/>", "b.xml": b"<b/>", "none": None}
    assert files.matching(spark, f"{tmp_path}/in/*.xml").count() == 1


def test_settings():
    assert files.parse_colour_map("[color_alias]\n[tags]\nTitle = (1, 2, 3)\nx = 7\n") == {"title": (1, 2, 3), "x": (7, 7, 7)}


def test_vocabulary_files(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("NA", 1)], "token string, count long")
    sinks.write_word_counts(counts, f"{tmp_path}/words", by_count=True)
    assert {r.token for r in files.vocabulary(spark, f"{tmp_path}/words").collect()} == {"a", "b", "NA"}
    (tmp_path / "e.txt.gz").write_bytes(gzip.compress(b"a 1 2 \n\nNA 3 4\n"))
    lines = files.embedding_lines(spark, f"{tmp_path}/e.txt.gz")
    assert [r.token for r in lines.collect()] == ["a", "NA"]
    sinks.write_lines(lines, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a 1 2", "NA 3 4"]


def test_tfrecord(spark, tmp_path):
    spark.dataSource.register(tfrecord.TfRecordSource)
    df = spark.createDataFrame([("u1", bytearray(b"\x00\xff"), 3), ("ü", bytearray(b""), -1)], "input_uri string, input_image binary, page_no long")
    df.coalesce(1).write.format("tfrecord").mode("append").save(f"{tmp_path}/rec")
    back = spark.read.format("tfrecord").schema(df.schema).load(f"{tmp_path}/rec")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert set(spark.read.format("tfrecord").load(f"{tmp_path}/rec").columns) == set(df.columns)
    assert tfrecord.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    with pytest.raises(ValueError, match="damaged"):
        list(tfrecord.read_frames(b"\0" * 20))
    kept = tfrecord.training_examples(back, (1, 5), epochs=2, seed=1)
    assert [r.page_no for r in kept.collect()] == [3, 3]


def test_external_programs(spark):
    out = external.converted(file_rows(spark, ("a", b"x")), external.command("no-such-program", "{input}")).first()
    assert out.content is None and "not installed" in out.error
    assert bytes(external.converted(file_rows(spark, ("a", b"x")), external.command("cp", "{input}", "{output}")).first().content) == b"x"


def test_png_and_images(spark):
    r = np.random.default_rng(1)
    image = r.integers(0, 255, (9, 7, 3), dtype=np.uint8)
    assert (R.decode_png(R.encode_png(image)) == image).all() and (R.decode_png(R.encode_png(image[:, :, 0]))[:, :, 1] == image[:, :, 0]).all()
    assert R.resize_nearest(image, (14, 18)).shape == (18, 14, 3) and (R.resize_bicubic(image, (7, 9)) == image).all()
    assert abs(R.similarity(image[:, :, 0], image[:, :, 0], 3) - 1) < 1e-9
    flat = np.zeros((3, 3, 3), np.uint8)
    flat[0] = (255, 0, 0)
    assert R.masks(flat, [(255, 0, 0)], unknown=True)[..., 1].sum() == 6 and R.colour_counts(flat) == {(0, 0, 0): 6, (255, 0, 0): 3}
    assert R.shares_within(flat, {"t": (255, 0, 0)}, 0, 0, 3, 2) == {"t": 0.5} and R.shares_within(flat, {"t": (255, 0, 0)}, 0, 0, 0, 0) == {"t": 0.0}
    assert (R.likeliest_colours(np.array([[[0.1, 0.9]]]), [(1, 1, 1), (2, 2, 2)]) == 2).all()
    assert (blocks.paint((3, 3), [(0, 0, 1, 1)], [(1, 2, 3)])[:2, :2] == (1, 2, 3)).all()
    images = spark.createDataFrame([(1, bytearray(R.encode_png(flat)))], "image_id int, png binary")
    assert raster.pixels(images).where("r = 255").count() == 3
    assert raster.colour_frequencies(images).where("r = 0").first().n == 6
    red = raster.recoloured(images, {(0, 0, 0): (255, 255, 255)}).first().png
    assert R.colour_counts(R.decode_png(bytes(red)))[(255, 255, 255)] == 6


def test_png_filters_are_undone():
    import struct
    import zlib

    r = np.random.default_rng(2)
    image = r.integers(0, 255, (5, 6), dtype=np.uint8)
    rows, above = [], np.zeros(6, int)
    for y, line in enumerate(image.astype(int)):
        left, corner = np.append(0, line[:-1]), np.append(0, above[:-1])
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(np.where((d[0] <= d[1]) & (d[0] <= d[2]), 0, np.where(d[1] <= d[2], 1, 2)), [left, above, corner])
        guess = [np.zeros(6, int), left, above, (left + above) // 2, paeth][y]
        rows.append(bytes([y]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    data = R.SIGNATURE + R._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + R._chunk(b"IDAT", zlib.compress(b"".join(rows))) + R._chunk(b"IEND", b"")
    assert (R.decode_png(data)[:, :, 0] == image).all()


def test_graphics_on_pages(spark):
    r = np.random.default_rng(3)
    page = np.full((160, 120, 3), 255, np.uint8)
    graphic = np.repeat(np.repeat(r.integers(0, 255, (8, 10, 3), dtype=np.uint8), 5, 0), 5, 1)
    page[60:100, 30:80] = graphic
    png = lambda i: bytearray(R.encode_png(i))
    g = spark.createDataFrame([("d", "g1", png(graphic))], "doc_id string, graphic_id string, png binary")
    p = spark.createDataFrame([("d", 0, png(np.full_like(page, 255))), ("d", 1, png(page))], "doc_id string, page_idx int, png binary")
    m = raster.graphics_on_pages(g, p).first()
    assert m.page_idx == 1 and np.allclose((m.x, m.y, m.width, m.height), (30, 60, 50, 40), atol=10)
    coco = raster.coco_documents(spark.createDataFrame([("d", "g", 1, "figure", 30.0, 60.0, 50.0, 40.0)], "doc_id string, graphic_id string, page_idx int, category string, x double, y double, width double, height double")).first().json
    assert '"category_id":1' in coco and "page_00002" in coco


def test_page_predictions(spark):
    image = np.zeros((40, 50, 3), np.uint8)
    image[:20] = (9, 9, 9)
    t = documents.tokens(file_rows(spark, ("a", layout(["ab"]))))
    i = spark.createDataFrame([("a", 0, bytearray(R.encode_png(image)))], "doc_id string, page_idx int, png binary")
    assert raster.annotate_by_images(t, i, documents.pages(t), {"top": (9, 9, 9)}).first().cv_tag == "top"


def test_sequence_model(spark):
    x = [[{"w": w} for w in s.split()] for s in ("a b c", "b c a", "c a b", "a a b")]
    y = [["A" if f["w"] == "a" else "B" for f in s] for s in x]
    model = crf.train(x, y)
    assert [model.predict(s) for s in x] == y and crf.Crf.from_json(model.to_json()).predict(x[0]) == y[0] and model.predict([]) == []


def test_autocut():
    inputs = ["Title: The scientific life of mice", "Title: Of men", "Title: Some other work here", "Title: On the origin"]
    model = crf.fit_autocut(inputs, [x[7:] for x in inputs])
    assert [crf.autocut(model, x) for x in inputs] == [x[7:] for x in inputs]
    assert crf.cut("abc", "___") == "" and crf.cut("abcd", "_xx_") == "bc"


def test_gradient_of_sequence_model_drives_loss_down():
    x = [[{"w": w, "n": str(i % 2)} for i, w in enumerate("abcab")]] * 2
    y = [list("XYXYX"), list("XYXXX")]
    m = crf.train(x, y, c1=0.0, c2=0.01, iterations=60)
    assert set(m.predict(x[0])) <= {"X", "Y"} and np.abs(m.state).max() > 0.1


def test_training_data_and_conversion(spark):
    mapping = {"article": {"manuscript_title": "front/title"}}
    pairs = spark.createDataFrame([("d1", bytearray(layout(["The big title here", "and more"], ["1 a", "2 b", "3 c"])), "<article><front><title>The big title here</title></front></article>")], "source_url string, lxml binary, xml string")
    out = pipelines.training_data(pairs, mapping, {"manuscript_title": (255, 0, 0)}, least=0.1)
    tags = {(r.page_idx, r.line_idx, r.token_idx): r.tag for r in out["tokens"].where("tag IS NOT NULL").collect()}
    assert tags[0, 0, 0] == "b-manuscript_title" and tags[0, 0, 3] == "i-manuscript_title" and tags[1, 0, 0] == "b-line_no"
    images = {r.page_idx: R.decode_png(bytes(r.png)) for r in out["images"].collect()}
    assert set(images) == {0, 1} and (images[0] == (255, 0, 0)).all(-1).any() and not (images[1] == (255, 0, 0)).all(-1).any()
    assert out["errors"].count() == 0
    xml = pipelines.extracted_xml(out["tokens"]).first().xml
    assert "<article-title>The big title here</article-title>" in xml
    model = crf.fit(pipelines.feature_rows(out["tokens"]).join(out["tokens"].withColumn("label", F.coalesce("tag", F.lit("O"))).transform(lambda d: __import__("folio.operators.tokens", fromlist=["x"]).with_ordinal(d, "ord")).select("doc_id", F.col("ord").cast("long").alias("ord"), "label"), ["doc_id", "ord"]))
    again = pipelines.converted(pairs.select(F.col("source_url").alias("path"), F.col("lxml").alias("content")), model).first().xml
    assert "The big title here" in again


def test_items_with_errors(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    done = spark.createDataFrame([("a.out",)], "path string")
    p = pipelines.ItemPipeline(lambda d: d.withColumn("error", F.when(F.col("name") == "b", "broken")), lambda: F.concat("name", F.lit(".out")))
    assert [r.name for r in p.run(items, done).collect()] == ["c"] and p.counts.get == {"items": 2, "errors": 1}
    p.skip_errors = False
    with pytest.raises(Exception, match="broken"):
        p.run(items, done).collect()


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    q = word_counts.start(word_counts.counts(spark, f"{tmp_path}/in"), "stream_words", f"{tmp_path}/state")
    q.awaitTermination(60)
    assert {r.token: r.n for r in spark.table("stream_words").collect()} == {"a": 2, "b": 2}


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("x/a.xml", "<a/>"), ("b.xml.gz", "<b/>")], "n string, c string")
    assert sorted(r.bytes for r in sinks.write_files(df, f"file://{tmp_path}/out", F.col("n"), F.col("c")).collect()) == [4, 4]
    assert (tmp_path / "out/x/a.xml").read_text() == "<a/>" and gzip.decompress((tmp_path / "out/b.xml.gz").read_bytes()) == b"<b/>"
    assert len(list((tmp_path / "out").rglob("*.*"))) == 2


def test_service_answers_replace_authors_and_affiliations():
    xml = "<article><front><article-meta><contrib-group><contrib>A B, C D</contrib><aff>Dept, Uni</aff></contrib-group></article-meta></front></article>"
    asked = []
    names = lambda t: asked.append(t) or '<persName xmlns="http://www.tei-c.org/ns/1.0"><forename>Ann</forename><forename>M</forename><surname>Bee</surname></persName><persName xmlns="http://www.tei-c.org/ns/1.0"><surname>Dee</surname></persName>'
    places = lambda t: '<affiliation><orgName type="department">Maths</orgName><orgName type="institution">Uni</orgName></affiliation>'
    out = external.enhanced(xml, names, places).decode()
    assert asked == ["A B, C D"]
    assert "<contrib><surname>Bee</surname><given-names>Ann M</given-names></contrib><contrib><surname>Dee</surname></contrib>" in out
    assert '<aff><addr-line><named-content content-type="department">Maths</named-content></addr-line><institution>Uni</institution></aff>' in out
    assert external.enhanced("<article/>", names, places) == b"<article />"


def test_pages_of_a_program(spark, tmp_path):
    fake = tmp_path / "pages"
    fake.write_text('#!/bin/sh\ncat > /dev/null\nfor last; do :; done\nfor n in 1 2 10; do printf "page $n $3" > "$last-$n.png"; done\n')
    fake.chmod(0o755)
    files_ = spark.createDataFrame([("a.pdf", bytearray(b"%PDF"))], "path string, content binary")
    got = external.page_images(files_, external.pdf_pages(pages=(2, 4), program=str(fake)), first=2).collect()
    assert [(r.page_no, bytes(r.png)) for r in got] == [(2, b"page 1 2"), (3, b"page 2 2"), (4, b"page 10 2")]
    gone = external.page_images(files_, external.pdf_pages(program="/no/such/program")).first()
    assert gone.png is None and "not installed" in gone.error


def test_training_by_many_tasks_gives_the_weights_of_one(spark):
    import random

    r = random.Random(2)
    rows = []
    for d in range(12):
        for k in range(r.randint(1, 9)):
            w = r.choice(["a", "b", "c", "d"])
            rows.append((d, k, {"w": w, "n": str(k % 3)}, "A" if w in "ab" and r.random() < 0.9 else r.choice("BC")))
    df = spark.createDataFrame(rows, "doc_id long, ord long, features map<string,string>, label string").repartition(3)
    whole = crf.Crf.from_json(crf.fit(df))
    old, crf.TOKENS_A_TASK = crf.TOKENS_A_TASK, 10
    try:
        dealt = crf.Crf.from_json(crf.fit(df, in_one_task=0))
    finally:
        crf.TOKENS_A_TASK = old
    assert whole.labels == dealt.labels and whole.features == dealt.features
    assert np.abs(whole.state - dealt.state).max() < 1e-6 and np.abs(whole.move - dealt.move).max() < 1e-6 and np.abs(whole.state).max() > 0.1


def test_saved_models_and_columns(spark, tmp_path):
    model = crf.Crf(["_", "x"], {"ch.isdigit": 0}, np.array([[-1.0, 1.0]]), np.zeros((2, 2)))
    crf.save(spark, model.to_json(), f"{tmp_path}/m")
    again = crf.load(spark, f"{tmp_path}/m")
    assert again == model.to_json()
    df = spark.createDataFrame([("No 12",), ("none",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(crf.autocut_column(again)("t")).collect()] == ["12", "", None, ""]
    labels = spark.createDataFrame([("middle", "in the Middle of"), (None, "x"), ("", "ab"), ("q", "ab")], "a string, b string")
    assert [r[0] for r in labels.select(crf.aligned_labels(F.col("a"), F.col("b"))).collect()] == ["_______xxxxxx___", None, "__", "__"]


def test_annotation_documents(spark):
    g = spark.createDataFrame([("d", 1, 5, "b.png", "table", None), ("d", 2, 3, "a.png", "fig", "f1"), ("d", 3, 9, "c.png", "table", None), ("e", 1, 0, "x.png", "fig", None)], "doc_id string, graphic_id int, ord int, href string, category string, related_id string")
    p = spark.createDataFrame([("d", 0, "d/1.jpg", 100, 50, 200.0, 100.0), ("f", 0, "f/1.jpg", 10, 10, 10.0, 10.0)], "doc_id string, page_idx int, file_name string, width int, height int, pt_width double, pt_height double")
    found = spark.createDataFrame([("d", 1, 0, 0.9, -3.0, 4.4, 20.0, 60.0), ("d", 2, 0, 0.7, 1.0, 2.0, 3.0, 4.0)], "doc_id string, graphic_id int, page_idx int, score double, x double, y double, width double, height double")
    out = {r.doc_id: json.loads(r.j) for r in raster.annotation_documents(g, p, found, "now").select("doc_id", F.to_json("data").alias("j")).collect()}
    assert out["d"]["info"] == {"version": "0.0.2", "date_created": "now"} and out["d"]["images"][0]["pt_bbox"] == [0, 0, 200, 100]
    first, second = out["d"]["annotations"]
    assert first == {"file_name": "a.png", "category_id": 1, "related_element_id": "f1", "image_id": 1, "bbox": [1, 2, 3, 4], "pt_bbox": [2, 4, 6, 8], "_score": 0.7}
    assert second["bbox"] == [0, 4, 17, 46] and second["pt_bbox"] == [0, 8.8, 34, 91.2] and second["category_id"] == 2
    assert out["d"]["missing_annotations"] == [{"file_name": "c.png", "category_id": 2}] and out["d"]["categories"] == [{"id": 1, "name": "fig"}, {"id": 2, "name": "table"}]
    assert out["e"]["annotations"] == [] and out["e"]["images"] == [] and len(out["e"]["missing_annotations"]) == 1
    assert out["f"]["annotations"] == [] and out["f"]["categories"] == [] and "missing_annotations" not in out["f"]


def test_coordinates_in_xml(spark):
    xml = '<a xmlns:x="u"><fig><graphic x:href="p.png"/></fig><graphic href="q.png"/></a>'
    found = spark.createDataFrame([(1, "p.png", 2, 1.5, 2.0, 3.0, 4.0), (1, "p.png", 1, 0.0, 0.0, 1.0, 1.0)], "doc_id long, href string, page_no int, x double, y double, width double, height double")
    out = {r.doc_id: r.xml for r in targets.documents_with_coords(spark.createDataFrame([(1, xml), (2, xml), (3, None)], "doc_id long, xml string"), found).collect()}
    assert 'coords="1,0.0,0.0,1.0,1.0;2,1.5,2.0,3.0,4.0"' in out[1] and out[1].count("coords") == 1 and "coords" not in out[2] and out[3] is None


def test_media_boxes(spark):
    import zlib

    from folio.sources import pdf

    bodies = [b"<< /Type /Pages /Kids [2 0 R] /MediaBox [0 0 10 20] >> ", b"<< /Type /Page /Parent 1 0 R >>"]
    head = b"1 0 2 %d " % len(bodies[0])
    packed = zlib.compress(head + b"".join(bodies))
    stream = b"9 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(head), packed)
    plain = b"1 0 obj << /Type /Pages /Kids [2 0 R 3 0 R] /MediaBox [1 2 11.5 22] >> endobj 2 0 obj << /Type /Page /Parent 1 0 R /MediaBox [9 9 0 0] >> endobj 3 0 obj << /Type /Pages /Parent 1 0 R /Kids [4 0 R] >> endobj 4 0 obj << /Type /Page >> endobj"
    files = spark.createDataFrame([("s", bytearray(stream)), ("p", bytearray(plain)), ("bad", bytearray(b"x")), ("none", None)], "path string, content binary")
    got = sorted(pdf.page_boxes(files).collect(), key=lambda r: (r.path, r.page_idx or 0))
    assert [(r.path, r.x, r.y, r.width, r.height) for r in got if r.error is None] == [("p", 0, 0, 9, 9), ("p", 1, 2, 10.5, 20), ("s", 0, 0, 10, 20)]
    assert {r.path for r in got if r.error} == {"bad", "none"}


def test_longest_side_goes_to_the_program(tmp_path):
    from folio.sources import external

    program = tmp_path / "draw"
    program.write_text('#!/bin/sh\nfor last; do :; done\necho "$@" > "$last-1.png"\n')
    program.chmod(0o755)
    (out,) = external.pdf_pages(longest=800, program=str(program))(b"x")
    assert b"-scale-to 800" in out
