"""Subjects on a generated corpus with known truth, and the sentence rules."""

import random

import pytest

from hebbspark.llm import subjects as S

VOCABULARY = {
    "music": ["violin", "cello", "chord", "choir", "rehearsal", "melody", "score"],
    "sport": ["goalkeeper", "referee", "sprint", "racket", "playoff", "score"],
    "law": ["notary", "verdict", "plaintiff", "clause", "subpoena", "court"],
}
IDIOMS = ["That was a bitter pill.", "Keep score of what I told you.", "Case closed for now.", "The ball is in your court."]


def sentence(rng, subject):
    a, b = rng.sample(VOCABULARY[subject], 2)
    return rng.choice([f"Belna{rng.randint(1, 99)} lost the {a}, but Corwi keeps the {b}.", f"After the {a} arrived, Dalmo{rng.randint(1, 9)} repaired a {b}.", f"No {a} without a {b}: that was the rule."])


def corpus(seed, n):
    rng, rows, truth = random.Random(seed), [], {}
    for i in range(1, n + 1):
        main = rng.choice([*VOCABULARY, None])
        body = [rng.choice(IDIOMS) for _ in range(rng.randint(1, 4))]
        if main:
            body += [sentence(rng, main) for _ in range(rng.randint(5, 9))]
            if rng.random() < 0.3:
                body.append(sentence(rng, rng.choice([s for s in VOCABULARY if s != main])))
        rng.shuffle(body)
        text = " ".join(body)
        if i % 11 == 0:
            text = text.replace(" ", "")
        if i % 13 == 0:
            text = text.upper()
        rows.append((i, text))
        truth[i] = {main} if main else set()
    return rows, truth


@pytest.fixture(scope="module")
def fitted(spark):
    rows, truth = corpus(1, 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, next(iter(t), None), None) for i, t in truth.items() if i % 2]
    labels = [(i, s.upper() + " " if s and i % 5 == 0 else s, r) for i, s, r in labels] + [(1, "unknown", None), (None, "law", None), (99999, "law", None)]
    sub = spark.createDataFrame([(s, s, "") for s in VOCABULARY], "subject string, title string, description string")
    return docs, S.mine(docs, spark.createDataFrame(labels, "doc_id long, subject string, rater string"), sub), truth, sub


def test_held_out_documents(spark, fitted):
    docs, rules, truth, _ = fitted
    got = {}
    for r in S.document_subjects(docs, rules).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 2 == 0]
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right / len(held) > 0.95


def test_no_text_no_row(spark, fitted):
    _, rules, _, _ = fitted
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "Case closed for now."), (5, "\x00" * 50), (6, "x" * 70_000)], "doc_id long, text string")
    assert S.document_subjects(df, rules).count() == 0


def test_evidence_is_calibrated_on_other_documents(spark, fitted):
    rules = fitted[1]
    assert rules.sharpness in S.SHARPNESS
    shares, n = rules.document("The violin and the cello. A choir sang the melody. The referee saw the sprint.")
    assert n == 3 and abs(shares.sum() - 1) < 1e-9 and shares[rules.subjects.index("music")] > 0.5
    wrong = [("law", ["violin", "cello"]), ("sport", ["choir", "melody"])] * 20
    df = spark.createDataFrame(wrong, "subject string, words array<string>")
    again = S.calibrated(S.Rules(rules.subjects, rules.antecedents, rules.neutral, rules.params, rules.prior), df)
    assert again.sharpness == min(S.SHARPNESS)
    assert S.calibrated(again, df.limit(0)).sharpness == 1.0


def test_no_labels(spark, fitted):
    docs, _, _, sub = fitted
    rules = S.mine(docs, spark.createDataFrame([], "doc_id long, subject string, rater string"), sub)
    assert S.document_subjects(docs, rules).count() == 0


def test_redundant_rules_are_pruned(fitted):
    rules = fitted[1]
    assert ("violin",) in rules.antecedents
    long = [a for a in rules.antecedents if len(a) == 2 and "violin" in a and "cello" in a]
    assert not long


@pytest.mark.parametrize(
    "text,want",
    [
        ("- One two. Three!\n* Four", [["one", "two"], ["three"], ["four"]]),
        ('{"id": 1, "params": {"text": "One two."}}\n{"id":1,"ok":true}', [["one", "two"]]),
        ("[3 Jan 2025] Anna: tick=3 hits=2 One two", [["one", "two"]]),
        ("OneTwo.Three", [["onetwo"], ["three"]]),
        ("```\ncode here\n```\n| a | b |\nreal words", [["real", "words"]]),
        ("MaÃ±ana", [["mañana"]]),
    ],
)
def test_sentences(text, want):
    assert S.sentences(text) == want
