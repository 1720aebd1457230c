import itertools

import numpy as np
import pytest

from ledgerloom.llm import languages
from ledgerloom.llm.languages import fit, forward_backward, label_corpus, label_words, language_of_label, sentences_of, word_features

EN = ["The court had already held that the notice was late.", "It is common ground that the sum was paid on time.", "For these reasons the tenant must pay the costs.", "Having heard counsel, we are not persuaded by the report."]
DE = ["Das Gericht ist nicht überzeugt, dass die Kündigung rechtzeitig war.", "Mit Schreiben vom Montag rügte die Klägerin die Verspätung der Lieferung.", "Nichts spricht dafür, dass der Zeuge davon wusste.", "Der Betrag ist nach dem Vortrag der Parteien nicht bewiesen."]
FR = ["La cour avait déjà jugé que la clause est valable.", "Par ces motifs, le locataire devra payer la somme dans les trente jours.", "Rien ne laisse penser que le témoin connaissait le retard.", "Il est constant que la requérante conteste encore la valeur du terrain."]


def corpus():
    docs = []
    for i in range(60):
        for lang, s in (("en", EN), ("de", DE), ("fr", FR)):
            docs.append((f"{lang}-{'XX' if i % 2 else 'YY'}" if i % 3 else lang, " ".join(s[(i + k) % 4] for k in range(4))))
    return docs


@pytest.mark.parametrize("label,code", [("EN", "en"), ("en_GB", "en"), ("fra", "fr"), (" Deutsch ", "de"), ("und", None), ("n/a", None), ("", None), (None, None), ("xx", None), ("nl-BE", "nl")])
def test_labels(label, code):
    assert language_of_label(label) == code


def test_sentences():
    text = "HEADING\r\n\r\n(1)\tThe court in Ba. Ro said, at [2003] 6 Rec. 603, no more. It closed on 5.3.2001 at noon!\n\nno end here"
    got = [(" ".join(w), full) for _, _, w, full in sentences_of(text)]
    assert [f for _, f in got].count(True) >= 2 and got[0] == ("heading", False) and got[-1] == ("no end here", False)
    assert sentences_of("") == [] and sentences_of(" 12 \n") == []


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, s = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3))
    length = np.array([5, 3])
    gamma, pairs = forward_backward(e, length, s, transitions=True)
    want_pairs = np.zeros((3, 3))
    for r in range(2):
        total, marginal, moves = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=length[r]):
            p = np.exp(sum(e[r, t, y] for t, y in enumerate(path)) + sum(s[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                marginal[t, y] += p
            for a, b in zip(path, path[1:]):
                moves[a, b] += p
        assert np.allclose(gamma[r], marginal / total)
        want_pairs += moves / total
    assert np.allclose(pairs, want_pairs)


def test_a_long_text_is_one_chain(monkeypatch):
    """Side by side with others and in any grouping, a text has the posteriors of its whole chain."""
    field = fit([])
    field.weight[:] = np.random.default_rng(2).normal(scale=0.3, size=field.weight.shape)
    words = [f"w{i % 37}x{i % 11}" for i in range(3000)]
    docs = [[words], [["a", "b"]], [], [words[:900], words[900:1500]]]
    want = [forward_backward(field.word_scores([w for s in d for w in s])[None], np.array([sum(map(len, d))]), field.switch)[0][0] if d else np.zeros((0, len(field.languages))) for d in docs]
    for cells in (1, 5000, 400_000):
        monkeypatch.setattr(languages, "CELLS", cells)
        assert all(np.allclose(a, b) for a, b in zip(label_words(field, docs), want))


def test_features_depend_on_the_word_only():
    words = ["a", "of", "straße", "x" * 100, "naïve"]
    together = word_features(words)
    assert all((together[i] == word_features([w])[0]).all() for i, w in enumerate(words))
    assert together.max() < 2**16 and (together[0] == -1).any()


def test_documents_passages_and_wrong_labels(spark):
    docs = corpus()
    n = len(docs)
    docs += [
        ("de", " ".join(EN)), ("", " ".join(DE)), ("en", " ".join(EN * 2 + FR[:2] + EN)), ("en", " ".join(EN * 2 + FR[:1] + EN)),
        (None, None), ("en", ""), ("en", " 1 2 3 "), ("fr", " ".join(FR * 400) + " " + " ".join(DE[:3])), ("en", " ".join(EN) + "\n\nde la"),
    ]
    df = spark.createDataFrame([(i, t, x, "clash") for i, (x, t) in enumerate(docs)], "doc_id bigint, text string, lang string, key string")
    rows = label_corpus(df, "doc_id", "text", "lang").collect()
    main = {r.key: r.lang for r in rows if r.main}
    langs = {}
    for r in rows:
        langs.setdefault(r.key, set()).add(r.lang)
    assert all(main[i] == language_of_label(docs[i][0]) for i in range(n))
    assert main[n] == "en" and main[n + 1] == "de"
    assert langs[n + 2] == {"en", "fr"} and langs[n + 3] == {"en"}
    assert not {n + 4, n + 5, n + 6} & set(main)
    assert langs[n + 7] == {"fr", "de"} and main[n + 7] == "fr"
    assert all(0.3 < r.confidence <= 1 for r in rows)
    passage = next(r for r in rows if r.key == n + 2 and r.lang == "fr")
    assert docs[n + 2][1][passage.begin : passage.end].strip() == " ".join(FR[:2])


def test_no_usable_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, " ".join(FR), None), (None, " ".join(DE), "zz")], "doc_id bigint, text string, lang string")
    assert {(r.key, r.lang) for r in label_corpus(df, "doc_id", "text", "lang").collect() if r.main} == {(1, "fr"), (None, "de")}
    assert label_corpus(df.limit(0), "doc_id", "text", "lang").collect() == []


def test_held_out_accuracy():
    from ledgerloom.llm.languages import label_words

    field = fit(corpus())
    held_out = [(0, "the tenant was late and the report is not valid"), (1, "die Klägerin wusste nicht dass der Vortrag verspätet war"), (2, "le témoin conteste la somme dans ces jours")]
    names = ["en", "de", "fr"]
    for y, text in held_out:
        gamma = label_words(field, [[text.lower().split()]])[0]
        assert field.languages[gamma.sum(0).argmax()] == names[y]
