import unicodedata

import pytest
from pyspark.sql import functions as F

from askweave.functions import text as T
from askweave.operators.chunking import chunk_documents


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_fold_and_tokens(spark):
    assert one(spark, "Hoà Bình, Đà Nẵng", T.fold) == "hoa binh, da nang"
    assert one(spark, unicodedata.normalize("NFD", "Hoà Đà"), T.fold) == "hoa da"
    assert one(spark, "Ông là 50% của x", T.tokenize) == ["ong", "50%"]
    assert one(spark, "Đặng ß é", T.fold_keep_length) == "dang s e"


def test_nfc_and_answers(spark):
    assert one(spark, unicodedata.normalize("NFD", "ấ ộ Ử"), T.nfc) == "ấ ộ Ử"
    assert one(spark, "  Hà_Nội, (Việt Nam)! ", T.normalize_answer) == "hà nội việt nam"


def test_clean_html_and_accents(spark):
    assert one(spark, "<p>Hoà<script>x<b></script> , ok</p>", T.clean_html) == "Hòa, ok"
    assert one(spark, "oẽ", lambda x: T.place_accents(x, legacy=True)) == "ẽo"


def test_sentences(spark):
    text = 'TS. Nam đến. Ông "đi." Rồi về… Hết! 5. Sáu'
    assert one(spark, text, T.split_sentences) == ["TS. Nam đến.", 'Ông "đi.', "Rồi về…", "Hết!", "5. Sáu"]


def test_chunks(spark):
    docs = spark.createDataFrame([("D", "One alpha. Two beta. Three gamma. Four delta.", 12)], "id string, text string, page int")
    rows = chunk_documents(docs, "id", max_tokens=4, overlap_sentences=1, page_col="page").orderBy("passage_id").collect()
    assert [r.text for r in rows] == ["One alpha. Two beta.", "Two beta. Three gamma.", "Three gamma. Four delta."]
    assert (rows[0].passage_id, rows[0].paragraph_id, rows[0].sentence_start, rows[0].sentence_end, rows[0].page) == ("D_P0001", "D_PAR0001", 0, 1, 12)
    with pytest.raises(ValueError):
        chunk_documents(docs, "id", max_tokens=0)


def chunk_by_hand(text, size, overlap):
    sentences = [s for s in text.split(" | ")]
    out, start = [], 0
    while start < len(sentences):
        end, count = start, 0
        while end < len(sentences) and (end == start or count + len(sentences[end].split()) <= size):
            count += len(sentences[end].split())
            end += 1
        out.append(" ".join(sentences[start:end]))
        if end >= len(sentences):
            break
        start = max(start + 1, end - overlap)
    return out


@pytest.mark.parametrize("size,overlap", [(3, 0), (5, 2), (9, 1), (4, 5)])
def test_chunks_against_loop(spark, size, overlap):
    sentences = ["Ab cd." if i % 3 else "Ef gh ij." for i in range(17)]
    docs = spark.createDataFrame([("d", " ".join(sentences))], "id string, text string")
    got = [r.text for r in chunk_documents(docs, "id", max_tokens=size, overlap_sentences=overlap).orderBy("passage_id").collect()]
    assert got == chunk_by_hand(" | ".join(sentences), size, overlap)
