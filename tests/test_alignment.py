"""Position maps, spans in windows, and the reasons why spans are lost."""

import bisect
import random
import unicodedata

from pyspark.sql import functions as F

from askweave.operators import alignment

TEXTS = [
    ("Hà Nội là thủ đô của Việt Nam.", "Hà_Nội là thủ_đô của Việt_Nam ."),
    (unicodedata.normalize("NFD", "Thành phố Huế"), unicodedata.normalize("NFD", "Thành_phố  Huế")),
    ("  a\n\n𝒳 b_c  ", "A 𝒳_b c"), ("", ""), ("___ ", "_"), ("abc", "abd"), (None, "a"),
]


def _kept(text):
    return [i for i, c in enumerate(text or "") if not c.isspace() and c != "_"]


def test_spans_map_both_ways_as_by_hand(spark):
    rows = [(i, a, b, s, e) for i, (a, b) in enumerate(TEXTS) for s in range(-1, len(a or "")) for e in range(s, min(len(a or "") + 1, s + 7))]
    df = alignment.add_alignment(spark.createDataFrame(rows, "id int, raw string, model string, s int, e int"), "raw", "model")
    df = df.withColumn("m", alignment.map_span(F.col("raw_kept"), F.col("model_kept"), F.col("s"), F.col("e")))
    df = df.withColumn("b", alignment.map_span(F.col("model_kept"), F.col("raw_kept"), F.col("m.start"), F.col("m.end")))
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        raw, model = _kept(r["raw"]), _kept(r["model"])
        inside = [k for k, p in enumerate(raw) if r["s"] >= 0 and r["s"] <= p < r["e"]]
        expected = (model[inside[0]], model[inside[-1]] + 1) if inside else (-1, -1)
        assert tuple(r["m"]) == expected
        assert tuple(r["b"]) == ((raw[inside[0]], raw[inside[-1]] + 1) if inside else (-1, -1))
        assert r["aligned"] == (r["raw"] not in ("abc", None))


def test_compact_offsets_are_restored(spark):
    df = spark.createDataFrame([(" ab_c  d", [(0, 2), (2, 4), (3, 9), (4, 5), (1, 1)])], "t string, o array<struct<s:int,e:int>>")
    got = df.select(alignment.kept_positions(F.col("t")).alias("k"), "o").select(alignment.restore_offsets(F.col("k"), F.col("o")).alias("x")).first()["x"]
    assert [tuple(x) for x in got] == [(1, 3), (4, 8), (7, 8), (0, 0), (0, 0)]


def test_lines_and_tokens(spark):
    text = " one two\n\n \tthree_ \nfour"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n \n")], "id int, t string")
    got = {r["id"]: r for r in alignment.line_spans(alignment.add_tokens(df, "t")).collect()}
    assert [text[s:e] for s, e in zip(got[1]["token_starts"], got[1]["token_ends"])] == text.split()
    assert [text[s["start"]:s["end"]] for s in got[1]["spans"]] == ["one two", "three_", "four"]
    assert all(got[i]["spans"] == [] and got[i]["token_starts"] == [] for i in (2, 3, 4))


def test_window_reasons_against_every_window(spark):
    rng = random.Random(4)
    rows, expected, length, stride, asked = [], {}, 40, 10, 6
    room = length - asked - 4
    for key in range(12):
        words = ["w" * rng.randint(1, 6) for _ in range(rng.choice([3, 29, 30, 31, 700]))]
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [s + len(w) for s, w in zip(starts, words)]
        windows = [(0, min(room, len(words)))]
        while windows[-1][1] < len(words):
            begin = windows[-1][0] + room - stride
            windows.append((begin, min(begin + room, len(words))))
        spans = []
        for _ in range(60):
            a = rng.randrange(len(words))
            b = min(len(words) - 1, a + rng.choice([0, 3, 9, 10, 25, 40]))
            s, e = starts[a], ends[b] - rng.randint(0, 1)
            if e > s:
                spans.append((s, e))
        rows.append((key, " ".join(words), spans))
        for s, e in spans:
            first, last = bisect.bisect_right(starts, s) - 1, bisect.bisect_left(ends, e)
            held = any(w <= first and last < x for w, x in windows)
            n = last - first + 1
            if held and starts[first] == s and ends[last] == e:
                reason = None
            else:
                reason = ("ANSWER_EXCEEDS_WINDOW" if n > room else "ANSWER_LONGER_THAN_STRIDE" if n > stride
                          else "TOKENIZER_BOUNDARY" if held else "CHUNK_OR_TOKENIZER_MAPPING")
            expected[(key, s, e)] = (n, held, reason)
    rows += [(100, "", [(0, 0)]), (101, None, None), (102, "a b", [])]
    df = alignment.add_tokens(spark.createDataFrame(rows, "key int, t string, spans array<struct<start:int,end:int>>"), "t")
    got = alignment.window_reasons(df, ["key"], F.lit(asked), length, stride).collect()
    assert {(r["key"], r["start"], r["end"]): (r["n_tokens"], r["covered"], r["reason"]) for r in got} == expected and len(got) == len(expected)
    assert len({v[2] for v in expected.values()}) == 4
