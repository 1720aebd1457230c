"""The language of documents and of their passages, by a linear-chain conditional random field over words.

Each word is scored for each language from features: its affixes, the letter triples in it, the word itself
(hashed), and the short lists of function words it stands in.  Learned transitions join the scores of neighbouring
words; forward-backward gives every word the probability of each language.  Sentences take the language of their
words, runs of at least ``passage`` full sentences of one language are passages, and the language of most words is
the document's main one.

Labels are noisy, so the field is fitted on a bounded sample of labelled documents (``sample`` of them, taken by a
hash of their key) of which only those count whose label the function words bear out; a language that no sampled
document bears out is none of the corpus.  Fitting concatenates sentences of different languages, so that the
transitions see language changes, and takes at most ``FITTED`` words of a sentence, from a random place on.
Everything else covers all documents, and forward-backward runs over each text as one chain, however long it is;
texts of like lengths are scored side by side.  The languages are those of ``NOTATIONS``; a text of another one gets
the nearest of them.

Defined cases: null, blank and letterless texts have no language and give no row; an empty table gives an empty
result; with no usable label in the sample the function words alone decide; repeated documents are labelled each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Usual notations of language names besides the two-letter code; a region after - or _ is dropped.
NOTATIONS = {
    "en": "eng english anglais englisch inglés ingles inglês engels",
    "de": "deu ger german deutsch allemand alemán aleman alemão duits",
    "fr": "fra fre french français francais französisch francés frances francês frans",
    "es": "spa spanish español espanol castellano espagnol spanisch espanhol spaans",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portugees",
    "nl": "nld dut dutch nederlands vlaams flemish niederländisch néerlandais holandés holandês",
    "it": "ita italian italiano italienisch italien",
    "sv": "swe swedish svenska schwedisch suédois",
}
#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in was that is for on with by not which had be at this from are were has have but or as an it would been his their",
    "de": "der die das und ist nicht von dem den zu mit sei auf für dass ein eine des im wird werden hat aus bei nach auch als war sich oder",
    "fr": "le la les des et est que dans du une pour par sur pas au il qui ne avait été cette ont avec son sont mais aux ce un se",
    "es": "el la los las de que y en se del por con una para como su no al un es lo ha fue este pero sus más ser había",
    "pt": "o a os as de que e do da em não para com uma se no na por ao mas foi pelo dos das um sua são foram à ser",
    "nl": "de het een van en is dat in op te voor niet met aan zijn werd er heeft om door bij naar ook maar uit had worden deze als",
    "it": "il lo la i gli le di che e è in un una per non con del della dei al sono da ha si come nel ma anche questo",
    "sv": "och att det som en på är av för med den till inte om ett har de jag var men så han från vi kan när där sig",
}

BITS = 16
WIDTH = 20
#: Words (with what fills up shorter texts) that are scored side by side.
CELLS = 400_000
#: Words of a sentence that one fitted sequence takes, from a random place on.
FITTED = 60
_LETTERS = re.compile(r"[^\W\d_]+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n+|\f|\v")
_STOP = re.compile(r"""[.!?]["»”’')\]]*\s+(?=["«“„‘(\[]*(?:[^\W\d_]|[█▇▮…\[]))""")
_ENDS = re.compile(r"""[.!?]["»”’')\]\s]*$""")
LEAST_WORDS = 4


def language_of_label(label: str | None) -> str | None:
    """The two-letter code a label names, or None."""
    if label is None:
        return None
    s = label.strip().lower()
    if s in _CODES:
        return _CODES[s]
    return _CODES.get(re.split(r"[-_]", s, maxsplit=1)[0])


_CODES = {n: code for code, names in NOTATIONS.items() for n in [code, *names.split()]}


def _cuts(paragraph: str) -> Iterator[re.Match]:
    """Sentence ends: a stop before a word, unless it closes an initial or another abbreviation of one letter."""
    for m in _STOP.finditer(paragraph):
        i = m.start()
        if i > 1 and paragraph[i - 1].isalpha() and not paragraph[i - 2].isalnum():
            continue
        yield m


def sentences_of(text: str) -> list[tuple[int, int, list[str], bool]]:
    """(begin, end, words, full) of each sentence; headings and fragments are not full."""
    out = []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    at = 0
    for part in [*_PARAGRAPH.finditer(text), None]:
        stop = part.start() if part else len(text)
        paragraph = text[at:stop]
        begin = 0
        for cut in [*_cuts(paragraph), None]:
            end = cut.start() + 1 if cut else len(paragraph)
            piece = paragraph[begin:end]
            words = _LETTERS.findall(piece.lower())
            if words:
                full = len(words) >= LEAST_WORDS and (cut is not None or bool(_ENDS.search(piece)))
                out.append((at + begin, at + end, words, full))
            begin = cut.end() if cut else end
        at = part.end() if part else stop
    return out


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features of each word, -1 where a short word has none: two prefixes, four suffixes, triples, the word."""
    n = len(words)
    codes = np.zeros((n, WIDTH), np.uint64)
    size = np.empty(n, np.int64)
    for i, w in enumerate(words):
        if len(w) > WIDTH - 2:  # the ends of very long words say enough
            w = w[:9] + w[-9:]
        size[i] = len(w) + 2
        codes[i, 1 : len(w) + 1] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    rows = np.arange(n)
    codes[:, 0] = 2
    codes[rows, size - 1] = 3
    out = np.full((n, 7 + WIDTH - 2), -1, np.int64)
    rolled = np.zeros(n, np.uint64)
    whole = np.zeros((n, WIDTH), np.uint64)
    for k in range(WIDTH):
        rolled = rolled * np.uint64(1000003) + codes[:, k]
        whole[:, k] = rolled
    out[:, 0] = _hash(whole[rows, size - 1], 1)
    for column, k in ((1, 2), (2, 3)):
        ok = size - 2 > k
        out[ok, column] = _hash(whole[ok, k], 2 + k)
    tail = np.zeros(n, np.uint64)
    for k in range(1, 5):
        ok = size - 2 >= k
        tail[ok] = tail[ok] * np.uint64(1000003) + codes[rows[ok], size[ok] - 1 - k]
        use = size - 2 > k if k > 1 else ok
        out[use, 2 + k] = _hash(tail[use], 10 + k)
    for k in range(WIDTH - 2):
        ok = size >= k + 3
        triple = (codes[ok, k] * np.uint64(0x110000) + codes[ok, k + 1]) * np.uint64(0x110000) + codes[ok, k + 2]
        out[ok, 7 + k] = _hash(triple, 20)
    return out


@dataclass
class Field:
    """The fitted field: languages, feature weights, weights of the function-word lists, log transitions."""

    languages: list[str]
    weight: np.ndarray  # (2^BITS + 1) x languages, the last row is for no feature
    listed: np.ndarray  # lists x languages
    switch: np.ndarray  # languages x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        return _scores(word_features(words), _listed(words, self.languages), self.weight, self.listed)


def _listed(words: list[str], languages: list[str]) -> np.ndarray:
    sets = [frozenset(FUNCTION_WORDS[x].split()) for x in languages]
    known = {w: np.array([w in s for s in sets], float) for w in frozenset().union(*sets)} if sets else {}
    out = np.zeros((len(words), len(sets)))
    for i, w in enumerate(words):
        if w in known:
            out[i] = known[w]
    return out


def _scores(features: np.ndarray, listed: np.ndarray, weight: np.ndarray, of_list: np.ndarray) -> np.ndarray:
    out = listed @ of_list
    for k in range(features.shape[1]):
        out += weight[features[:, k]]
    return out


def forward_backward(emission: np.ndarray, length: np.ndarray, switch: np.ndarray, transitions: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, expected transitions if asked for) of sequences side by side; emission is (sequence, place, language) scores."""
    n, t, k = emission.shape
    e = np.exp(emission - emission.max(2, keepdims=True))
    move = np.exp(switch)
    inside = np.arange(t)[None, :] < length[:, None]
    # by place first, so that each step works on neighbouring memory
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    alpha = np.empty((t, n, k))
    a = e[0] / e[0].sum(1, keepdims=True)
    alpha[0] = a
    for i in range(1, t):
        a = (a @ move) * e[i]
        a /= a.sum(1, keepdims=True)
        alpha[i] = a
    beta = np.ones((n, k))
    pairs = np.zeros((k, k))
    gamma = alpha.copy() if transitions else alpha
    for i in range(t - 2, -1, -1):
        live = inside[:, i + 1]
        carried = e[i + 1] * beta
        if transitions:
            norm = ((alpha[i] @ move) * carried).sum(1)
            weight = np.where(live, 1 / np.maximum(norm, 1e-300), 0)
            pairs += move * np.einsum("na,nb,n->ab", alpha[i], carried, weight)
        back = carried @ move.T
        back /= back.sum(1, keepdims=True)
        beta = np.where(live[:, None], back, 1.0)
        gamma[i] *= beta
    gamma = gamma.transpose(1, 0, 2)
    gamma /= gamma.sum(2, keepdims=True)
    gamma[~inside] = 0
    return gamma, pairs


def borne_out(words: list[str], languages: list[str]) -> tuple[str | None, float]:
    """The language of most function words, and its lead over the next one as a share of all."""
    sets = {x: frozenset(FUNCTION_WORDS[x].split()) for x in languages}
    n = {x: sum(w in s for w in words) for x, s in sets.items()}
    order = sorted(languages, key=lambda x: (-n[x], x))
    if not order or not n[order[0]]:
        return None, 0.0
    return order[0], (n[order[0]] - (n[order[1]] if len(order) > 1 else 0)) / n[order[0]]


def fit(labelled: list[tuple[str, str]], *, rounds: int = 60, sequences: int = 1200, seed: int = 7) -> Field:
    """From (label, text) pairs of a bounded sample."""
    candidates = sorted(NOTATIONS)
    by_language: dict[str, list[list[str]]] = {}
    for label, text in labelled:
        code = language_of_label(label)
        if code is None or not text:
            continue
        parts = [w for _, _, w, full in sentences_of(text) if full]
        own, lead = borne_out([w for p in parts for w in p], candidates)
        if own != code or lead < 0.2:
            continue
        # sentences that the function words clearly give to another language are passages of it
        for p in parts:
            x, margin = borne_out(p, candidates)
            if x == code or margin < 0.3:
                by_language.setdefault(code, []).append(p)
    languages = sorted(x for x, p in by_language.items() if len(p) >= 5) or candidates
    k = len(languages)
    of_list = np.eye(k) * 2.0
    switch = np.full((k, k), -5.0) + np.eye(k) * 5.0
    weight = np.zeros((2**BITS + 1, k))
    if languages is candidates:
        return Field(languages, weight, of_list, switch)
    rng = np.random.default_rng(seed)
    words: dict[str, int] = {}
    data = []
    for _ in range(sequences):  # two to five sentences, each run of one language
        ids, ys = [], []
        y = rng.integers(k)
        for _ in range(rng.integers(2, 6)):
            if rng.random() < 0.35:
                y = rng.integers(k)
            p = by_language[languages[y]]
            s = p[rng.integers(len(p))]
            if len(s) > FITTED:
                at = rng.integers(len(s) - FITTED + 1)
                s = s[at : at + FITTED]
            ids += [words.setdefault(w, len(words)) for w in s]
            ys += [y] * len(s)
        data.append((ids, ys))
    features = word_features(list(words))
    listed = _listed(list(words), languages)
    t = max(len(i) for i, _ in data)
    ids = np.zeros((len(data), t), np.int64)
    ys = np.zeros((len(data), t), np.int64)
    length = np.array([len(i) for i, _ in data])
    for r, (i, y) in enumerate(data):
        ids[r, : len(i)], ys[r, : len(y)] = i, y
    used, place = np.unique(np.where(features < 0, 2**BITS, features), return_inverse=True)
    place = place.reshape(features.shape)
    w = np.zeros((len(used), k))
    dead = used == 2**BITS
    params, state = [w, of_list, switch], []
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    steps = np.arange(t)
    for i in range(1, rounds + 1):
        batch = rng.permutation(len(data))[: max(1, len(data) // 3)]
        score = listed @ of_list
        for c in range(place.shape[1]):
            score += w[place[:, c]]
        b_ids, b_ys, b_len = ids[batch], ys[batch], length[batch]
        inside = steps[None, :] < b_len[:, None]
        gamma, pairs = forward_backward(score[b_ids], b_len, switch, transitions=True)
        gold = np.eye(k)[b_ys] * inside[:, :, None]
        gap = (gold - gamma)[inside]
        by_word = np.stack([np.bincount(b_ids[inside], gap[:, c], len(score)) for c in range(k)], 1)
        g_w = np.zeros_like(w)
        for c in range(place.shape[1]):
            for x in range(k):
                g_w[:, x] += np.bincount(place[:, c], by_word[:, x], len(w))
        g_list = listed.T @ by_word
        gold_pairs = np.zeros((k, k))
        both = inside[:, 1:]
        np.add.at(gold_pairs, (b_ys[:, :-1][both], b_ys[:, 1:][both]), 1)
        grads = [g_w / len(batch) - 1e-4 * w, g_list / len(batch), (gold_pairs - pairs) / len(batch)]
        for p, g, (m, v) in zip(params, grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.08 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w[dead] = 0
    weight[used] = w
    weight[2**BITS] = 0
    return Field(languages, weight, of_list, switch)


def label_words(field: Field, docs: list[list[list[str]]]) -> list[np.ndarray]:
    """For documents as lists of sentences of words: the posteriors of all words, document by document."""
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(w, len(known)) for s in d for w in s], np.int64) for d in docs]
    scores = field.word_scores(list(known))
    out = [np.zeros((len(x), len(field.languages))) for x in ids]
    order, at = sorted((d for d in range(len(ids)) if len(ids[d])), key=lambda d: len(ids[d])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(ids[order[end]]) <= CELLS:
            end += 1
        some, at = order[at:end], end
        emission = np.zeros((len(some), len(ids[some[-1]]), len(field.languages)))
        for r, d in enumerate(some):
            emission[r, : len(ids[d])] = scores[ids[d]]
        gamma, _ = forward_backward(emission, np.array([len(ids[d]) for d in some]), field.switch)
        for r, d in enumerate(some):
            out[d] = gamma[r, : len(ids[d])]
    return out


def label_corpus(documents: DataFrame, key: str, text: str, label: str, *, sample: int = 1500, passage: int = 2, group: int = 8_000_000) -> DataFrame:
    """(key, label, lang, confidence, begin, end, n_sentences, main): each passage, and the main language with begin -1.

    Texts are worked on in groups of about ``group`` characters.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    named = docs.where("key is not null and label is not null").select("key", "label")
    chosen = [r[0] for r in named.orderBy(F.xxhash64("key"), "key").limit(sample).select("key").collect()]
    labelled = docs.where(F.col("key").isin(chosen)).select("label", "text").where("text is not null").orderBy("label", F.xxhash64("text")).limit(2 * sample).collect() if chosen else []
    field = fit([(r.label, r.text) for r in labelled])
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            order = np.cumsum([len(t) for t in texts]) // group if texts else np.zeros(0, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), len(texts)]
            for a, z in zip(cuts, cuts[1:]):
                part = b.slice(a, z - a)
                rows = [(i, s) for i, t in enumerate(texts[a:z]) if t and (s := sentences_of(t))]
                if not rows:
                    continue
                posteriors = label_words(field, [[s[2] for s in sentences] for _, sentences in rows])
                out = []
                for (i, sentences), gamma in zip(rows, posteriors):
                    out += [(i, *x) for x in _passages(field.languages, sentences, gamma, passage)]
                columns = list(zip(*out))
                taken = pa.array(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(taken), part.column(2).take(taken), pa.array(columns[1]), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.bool_())],
                    ["key", "label", "lang", "confidence", "begin", "end", "n_sentences", "main"],
                )

    return docs.where(F.col("text").isNotNull()).mapInArrow(run, f"key {kind}, label string, lang string, confidence double, begin int, end int, n_sentences int, main boolean")


def _passages(languages: list[str], sentences: list, gamma: np.ndarray, least: int) -> list[tuple]:
    """The main language and every passage of at least ``least`` full sentences."""
    ends = np.cumsum([len(s[2]) for s in sentences])
    sums = np.add.reduceat(gamma, np.concatenate([[0], ends[:-1]]), axis=0)
    full = np.array([s[3] for s in sentences])
    counted = sums[full] if full.any() else sums
    total = counted.sum(0)
    main = int(total.argmax())
    out = [(languages[main], float(total[main] / total.sum()), -1, -1, int(full.sum()), True)]
    own = sums.argmax(1)
    runs: list[list[int]] = []
    for i in np.flatnonzero(full):
        if runs and own[runs[-1][0]] == own[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    for r in runs:
        if len(r) >= least:
            s = sums[r].sum(0)
            x = own[r[0]]
            out.append((languages[x], float(s[x] / s.sum()), sentences[r[0]][0], sentences[r[-1]][1], len(r), False))
    return out
