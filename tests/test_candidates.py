import random

from askweave.operators import followups, gold


def kept(monkeypatch, module):
    stored, write = {}, module.materialize

    def counted(df, label):
        out = write(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(module, "materialize", counted)
    return stored


def test_questions_with_few_common_words_are_no_pairs(spark, monkeypatch):
    """All questions share two long words that come first in the order; only the two that are alike leave the join."""
    rng, stored = random.Random(8), kept(monkeypatch, followups)
    rows = [(i, "incomprehensibilities counterrevolutionary " + " ".join(f"w{rng.randrange(500)}" for _ in range(12))) for i in range(200)]
    rows.append((900, rows[17][1] + " more"))
    got = followups.similar_questions(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.6).collect()
    assert [(r["left"], r["right"]) for r in got] == [(17, 900)]
    assert stored["question-pairs"] <= 5


def test_long_texts_that_differ_are_not_compared_word_by_word(spark, monkeypatch):
    """Texts of thousands of words, alike in length and in their long words, keep marks that tell them apart."""
    rng, stored = random.Random(9), kept(monkeypatch, gold)
    texts = [" ".join([f"longlonglong{i}" for i in range(400)] + [f"v{x}" for x in rng.sample(range(100_000), 3000)]) for _ in range(30)]
    texts.append(texts[4].replace("v1", "u1", 40))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    got = gold.best_overlap(docs.selectExpr("doc_id AS query_id", "text AS context"), docs, 0.8, others_only=True).collect()
    overlap = round(len(sets[4] & sets[30]) / len(sets[4] | sets[30]), 6)
    assert sorted((r["query_id"], r["doc_id"], r["overlap"]) for r in got) == [(4, 30, overlap), (30, 4, overlap)] and overlap >= 0.8
    assert stored["overlap-pairs"] > 500 and stored["overlap-alive"] == 2


def test_fields_of_unequal_length_are_folded():
    long, short = gold._folded(0b1000_0001 << 64 | 0b10, 128, 64), gold._folded(0b1000_0011, 64, 64)
    assert long == short
