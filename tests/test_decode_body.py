from charset_normalizer import from_bytes
from weblake.operators import html


def test_detection_reads_the_whole_body(spark):
    head = "<head>" + "a script of plain letters; " * 3000
    said = {"utf-8": "Élève à l'école, où l'été s'achève déjà. " * 40, "cp1252": "Élève à l'école, où l'été s'achève déjà. " * 900, "shift_jis": "これは日本語の文章です。今日はとても良い天気ですね。" * 900}
    rows = [(k, (head + t).encode(k)) for k, t in said.items()] + [("cut", ("x" * 65535 + "é" * 50).encode()), ("none", None), ("empty", b"")]
    docs = spark.createDataFrame([(k, bytearray(b) if b is not None else None, None) for k, b in rows], "id string, body binary, encoding string")
    got = {r.id: r.text for r in html.decode_body(docs).collect()}
    assert got["utf-8"] == head + said["utf-8"] and got["cut"] == "x" * 65535 + "é" * 50
    # Which of the single-byte encodings it is, is the detector's guess from all bytes.
    whole = dict(rows)["cp1252"]
    assert got["cp1252"] == whole.decode(from_bytes(whole).best().encoding) and "\ufffd" not in got["cp1252"]
    assert got["shift_jis"] == head + said["shift_jis"]
    assert got["none"] is None and got["empty"] == ""
