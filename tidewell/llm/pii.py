"""Personal data: a linear-chain conditional random field over word-shape features.

It is trained from a small labelled table by maximum likelihood and decoded by Viterbi in numpy batches of sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import col, load, slices, texts, tune

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
NEVER = -1e4
PLAIN = r"^\p{L}+[.,;:!?]*$"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


# ---- the labelled table ----------------------------------------------------------------------------------------------


def labelled(n: int = 900, seed: int = 7) -> list[tuple[int, int, str, str]]:
    """(sentence, position, token, tag) of n made-up sentences with personal data, secrets and look-alikes among words."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    syllables = "an the er on st in ou re ti le que ent de la ción ar os ung sch ä eux é br ol mi za ko ru".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def email() -> list[str]:
        user = pick([lambda: f"{word()}.{digits(2)}", word, lambda: f"{word()}.{word()}", lambda: f"{word()}_{digits(3)}", lambda: f"{word()}+{word()}", lambda: f".{digits(2)}", lambda: f"{pick('abcdefgh')}{word()}{digits(1)}"])()
        host = pick([lambda: f"mail{digits(1)}.example", word, lambda: f"{word()}-{word()}", lambda: f"{word()}.{word()}"])()
        return [f"{user}@{host}.{pick(['com', 'org', 'net', 'de', 'co.uk', 'fr', 'io'])}"]

    def phone() -> list[str]:
        return pick([
            lambda: [f"+{pick(['1', '44', '49', '33', '34'])}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"+1", f"({digits(3)})", f"555-{digits(4)}"], lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
            lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [f"+{digits(2)}", digits(2), digits(4), digits(4)], lambda: [f"+{digits(11)}"], lambda: [f"+1-{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [f"({digits(3)}){digits(3)}-{digits(4)}"],
        ])()

    octet = lambda: str(rng.integers(1, 256))
    makers = {
        "EMAIL": email,
        "PHONE": phone,
        "IP": lambda: [".".join(octet() for _ in range(4))],
        "CARD": lambda: pick([lambda: ["4" + digits(15)], lambda: ["4" + digits(15)], lambda: [digits(15)], lambda: [digits(4) for _ in range(4)], lambda: ["-".join(digits(4) for _ in range(4))]])(),
        "SECRET": lambda: pick([
            lambda: ["AKIA" + "".join(pick(upper) for _ in range(16))], lambda: ["AKIA" + "".join(pick(upper[:26]) for _ in range(16))], lambda: [f'"{hexes(40)}"'], lambda: [f"{pick(['password', 'passwd', 'pwd', 'secret', 'token', 'api_key'])}={hexes(int(rng.integers(12, 24)))}"],
            lambda: [f"ghp_{''.join(pick(upper.lower() + upper) for _ in range(30))}"], lambda: [hexes(int(rng.integers(32, 65)))], lambda: [f"{pick(['password', 'key', 'secret'])}:{hexes(16)}"], lambda: ["sk-" + hexes(24)],
        ])(),
        "ID": lambda: pick([lambda: [f"{digits(3)}-{digits(2)}-{digits(4)}"], lambda: [f"{pick(['DE', 'FR', 'GB', 'ES'])}{digits(18)}"]])(),
    }
    before = {"SECRET": [["token", "="], ["token", "="], ["key", ":"], []], "PHONE": [["call"], ["phone:"], ["tel"], [], []], "EMAIL": [["mail"], ["contact"], [], []], "IP": [["from"], ["host"], [], []], "CARD": [["card"], [], []], "ID": [["SSN"], ["IBAN"], [], []]}
    fakes = [
        lambda: [str(rng.integers(1, 100))], lambda: [str(rng.integers(1900, 2100))], lambda: [f"{digits(1)}.{digits(1)}"], lambda: [f"{digits(1)}.{digits(1)}."], lambda: ["version", f"{digits(1)}."], lambda: [f"{digits(2)}:{digits(2)}"],
        lambda: [f"20{digits(2)}-0{pick('123456789')}-{digits(2)}"], lambda: [f"${digits(2)}.{digits(2)}"], lambda: [f"{digits(1)},{digits(3)}"], lambda: [f"{digits(2)}%"], lambda: [f"v{digits(1)}.{digits(1)}.{digits(1)}"],
        lambda: [f"https://{word()}.example.com/{word()}/{digits(5)}"], lambda: [f"#{word()}"], lambda: ["="], lambda: ["|"], lambda: ["-"], lambda: [f"({word()})"], lambda: [f"[{digits(2)}]"], lambda: [f"{word().upper()}-{digits(3)}"],
        lambda: [f"{word()}{pick(['&&&', '%%%', '###', '$$$', '***', '!!'])}"], lambda: [f"{word().upper()}!!"], lambda: ["".join(word() for _ in range(6)).upper()], lambda: [f'"{word()}"'], lambda: [f"{word()}'{word()}"], lambda: [f"{word()}-{word()}"], lambda: ["token"], lambda: ["password"], lambda: [f"@{word()}"],
        lambda: [f"{word()}={word()}"], lambda: [f"{digits(1)}/{digits(1)}"], lambda: [f"{digits(2)}th"], lambda: [f"{digits(4)},"], lambda: [f"0x{hexes(2)}"], lambda: [f"{digits(2)}.{digits(2)}.{digits(4)}"], lambda: ["BY-NC"], lambda: [f"({digits(2)})"],
        lambda: [digits(3)], lambda: [digits(5)], lambda: [digits(6)], lambda: [f"{digits(3)}-{digits(3)}"], lambda: [f"+{digits(2)}%"], lambda: [f"{word()}{digits(1)}"], lambda: ["CC"], lambda: [f"<{word()}>"], lambda: [f"{word()},{word()}"], lambda: [f"{digits(2)}-{digits(2)}"],
    ]
    out = []
    for s in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(rng.integers(1, 5)):
            for _ in range(rng.integers(0, 6)):
                w = word()
                w = w.upper() if rng.random() < 0.08 else w.capitalize() if rng.random() < 0.2 else w
                row.append((w + (pick(",;:") if rng.random() < 0.12 else ""), "O"))
            what = rng.random()
            if what < 0.5:
                k = pick(KINDS)
                tokens = makers[k]()
                if rng.random() < 0.25:
                    tokens[-1] += pick([".", ",", "%%%", "&&&", "###", "$$$", "***", "!!", ")", ";"])
                row += [(t, "O") for t in pick(before[k])] + [(t, f"{'I' if i else 'B'}-{k}") for i, t in enumerate(tokens)]
            elif what < 0.9:
                row += [(t, "O") for t in pick(fakes)()]
        if row and rng.random() < 0.7 and row[-1][1] == "O":
            row[-1] = (row[-1][0] + pick(".!?"), "O")
        out += [(s, i, t, y) for i, (t, y) in enumerate(row)]
    return out


# ---- features --------------------------------------------------------------------------------------------------------


def shape(token: str) -> str:
    """The token with letters as a or A and digits as 9, runs cut to one, at most 10 signs."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", token)))[:10]


def kind_of(token: str) -> str:
    """A coarse class for the neighbours' sake: plain words by case, known words by themselves, others by short shape."""
    bare = token.rstrip(".,;:!?")
    if bare.isalpha():
        low = bare.lower()
        return f"w={low}" if low in KEYWORDS else "A" if bare.isupper() else "Aa" if bare[0].isupper() else "a"
    return "s=" + shape(token)[:4]


KEYWORDS = frozenset("token password passwd secret key phone tel call mail email contact card ssn iban host from".split())


def features(token: str) -> list[str]:
    """The names of the token's own features: its class, shape, length, digits, tell-tale signs, prefix and make-up."""
    core = re.sub(r"[^\w\"')\]]+$", "", token)
    core = core.strip("\"'")
    n = sum(c.isdigit() for c in core)
    out = [kind_of(token), "shape=" + shape(core), f"digits={min(n, 20)}", f"len={min(len(core), 24) // 3}"]
    if core.isalpha():
        return [*out, "caps", "pre=" + core[:4]] if len(core) >= 15 and core.isupper() else out
    for sign in "@=.:+-(/_":
        if sign in core:
            out.append(f"{sign}{min(core.count(sign), 4)}")
    out.append("first=" + core[:1] if not core[:1].isalnum() else "pre=" + core[:4] if core[:4].isupper() else "")
    tail = re.split(r"[=:]", core)[-1]
    if len(tail) >= 12 and re.fullmatch(r"[0-9a-f]+", tail) and not tail.isdigit():
        out.append("hex")
    if len(core) >= 16 and re.fullmatch(r"\w+", core) and n and any(c.isalpha() for c in core):
        out.append("mixed")
    if re.fullmatch(r"[^@\s]*@[\w.-]+\.[\w-]+", core):
        out.append("addr")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", core):
        out.append("quad")
    if len(core) >= 13 and core.replace("-", "").isdigit():
        out.append("long")
    low = re.split(r"[=:]", core)[0].lower()
    if "=" in core or ":" in core:
        out.append("key" if low in KEYWORDS or low in ("api_key", "pwd") else "pair")
    return [f for f in out if f]


# ---- the field -------------------------------------------------------------------------------------------------------


class Field:
    """Weights of own features, of the neighbours' classes, and of transitions."""

    def __init__(self, own: dict[str, np.ndarray], prev: dict[str, np.ndarray], after: dict[str, np.ndarray], move: np.ndarray, start: np.ndarray):
        self.own, self.prev, self.after, self.move, self.start = own, prev, after, move, start
        self.classes = {k: i for i, k in enumerate(sorted({*prev, *after}))}
        zero = np.zeros(len(TAGS), np.float32)
        names = [*self.classes]
        # the last two classes are an unknown one and the sentence's edge
        self.prev_w = np.array([*(prev.get(k, zero) for k in names), zero, prev.get("", zero)], np.float32)
        self.after_w = np.array([*(after.get(k, zero) for k in names), zero, after.get("", zero)], np.float32)
        m = move - move[0, 0]
        self.slack = float(max(m[0, 1:].max() + m[1:, 0].max(), m[1:, 1:].max(), (start[1:] - start[0]).max() + m[1:, 0].max(), m[0, 1:].max(), (start[1:] - start[0]).max(), 0.0)) + 1e-3

    def score(self, token: str) -> np.ndarray:
        out = np.zeros(len(TAGS), np.float32)
        for f in features(token):
            w = self.own.get(f)
            if w is not None:
                out += w
        return out


def allowed() -> np.ndarray:
    """Transitions that BIO forbids get NEVER."""
    t = np.zeros((len(TAGS), len(TAGS)))
    for j, y in enumerate(TAGS):
        if y[0] == "I":
            for i, x in enumerate(TAGS):
                if x[1:] != y[1:] or x == "O":
                    t[i, j] = NEVER
    return t


def train(rows: list[tuple[int, int, str, str]], rounds: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximise the conditional likelihood of the tags by Adam over the whole table; the same rows give the same field."""
    rows = sorted(rows)
    sentences: list[list[tuple[str, str]]] = []
    last = None
    for s, _, t, y in rows:
        if s != last:
            sentences.append([])
            last = s
        sentences[-1].append((t, y))
    sentences.sort(key=len, reverse=True)
    n, width, m = len(sentences), len(sentences[0]), len(TAGS)
    live = [sum(len(s) > t for s in sentences) for t in range(width)]  # those that have a token t come first
    tag = {y: i for i, y in enumerate(TAGS)}
    names: dict[str, int] = {}
    at, feature = [], []
    gold = np.zeros((n, width), np.int64)
    real = np.zeros((n, width), bool)
    for i, s in enumerate(sentences):
        kinds = ["", *(kind_of(t) for t, _ in s), ""]
        for j, (t, y) in enumerate(s):
            gold[i, j], real[i, j] = tag[y], True
            for f in [*features(t), "<" + kinds[j], ">" + kinds[j + 2]]:
                at.append(i * width + j)
                feature.append(names.setdefault(f, len(names)))
    order = np.argsort(feature, kind="stable")
    at_f, first = np.array(at)[order], np.searchsorted(np.array(feature)[order], np.arange(len(names)))
    at_t, feature_t = np.array(at), np.array(feature)
    begin = np.searchsorted(at_t, cells := np.flatnonzero(real.ravel()))
    w = np.zeros((len(names) + m + 1, m))
    forbidden = allowed()
    start_off = np.where([y[0] == "I" for y in TAGS], NEVER, 0.0)
    mean, var = np.zeros_like(w), np.zeros_like(w)
    want = np.zeros_like(w)
    flat = np.zeros((n * width, m))
    flat[cells, gold.ravel()[cells]] = 1
    want[: len(names)] = np.add.reduceat(flat[at_f], first, axis=0)
    np.add.at(want, (len(names) + gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    np.add.at(want, (np.full(n, len(names) + m), gold[:, 0]), 1)

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(1, rounds + 1):
        emit = np.zeros((n * width, m))
        emit[cells] = np.add.reduceat(w[feature_t], begin, axis=0)
        emit = emit.reshape(n, width, m)
        move, start = w[len(names) : -1] + forbidden, w[-1] + start_off
        alpha, beta, z = np.zeros((n, width, m)), np.zeros((n, width, m)), np.zeros(n)
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, width):
            alpha[: live[t], t] = soft(alpha[: live[t], t - 1, :, None] + move, 1) + emit[: live[t], t]
        for t in range(width - 2, -1, -1):
            k1 = live[t + 1]
            beta[:k1, t] = soft(move + (emit[:k1, t + 1] + beta[:k1, t + 1])[:, None, :], 2)
        for t in range(width):
            ends = slice(live[t + 1] if t + 1 < width else 0, live[t])
            z[ends] = soft(alpha[ends, t], 1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * real[:, :, None]
        got = np.zeros_like(w)
        got[: len(names)] = np.add.reduceat(p.reshape(-1, m)[at_f], first, axis=0)
        for t in range(1, width):
            k1 = live[t]
            got[len(names) : -1] += np.exp(alpha[:k1, t - 1, :, None] + move + (emit[:k1, t] + beta[:k1, t])[:, None, :] - z[:k1, None, None]).sum(0)
        got[-1] = p[:, 0].sum(0)
        g = (want - got) / n - decay * w
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        w += rate * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-8)
    part = lambda p: {f[1:]: w[i].astype(np.float32) for f, i in names.items() if f[0] == p}
    own = {f: w[i].astype(np.float32) for f, i in names.items() if f[0] not in "<>"}
    return Field(own, part("<"), part(">"), (w[len(names) : -1] + forbidden).astype(np.float32), (w[-1] + start_off).astype(np.float32))


@lru_cache(maxsize=2)
def standard() -> Field:
    return train(labelled())


def viterbi(emit: np.ndarray, off: np.ndarray, field: Field) -> np.ndarray:
    """The best tags of many sentences at once: emit has all their tokens' scores, off where each sentence begins."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], off[:-1][order]
    tags = np.zeros(len(emit), np.int8)
    if not len(n):
        return tags
    back = np.zeros((len(emit), emit.shape[1]), np.int8)
    best = field.start + emit[begin]
    finish = best.copy()
    for t in range(1, int(n[0])):
        live = int(np.searchsorted(-n, -t, side="left"))
        x = best[:live, :, None] + field.move
        at = begin[:live] + t
        back[at] = x.argmax(1)
        best = x.max(1) + emit[at]
        finish[:live] = best
    y = finish.argmax(1)
    cur = np.zeros(len(n), np.int64)
    cur[:] = y
    for t in range(int(n[0]) - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        at = begin[:live] + t
        tags[at] = cur[:live]
        if t:
            cur[:live] = back[at, cur[:live]]
    return tags


# ---- documents -------------------------------------------------------------------------------------------------------


def tokens(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Bytes of all texts; each token's begin and end in them; each token's text; the tokens themselves."""
    off = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    gap = SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    visible = ~gap
    first = np.flatnonzero(visible & np.r_[True, gap[:-1]] | visible & edge[:-1])
    final = np.flatnonzero(visible & np.r_[gap[1:], True] | visible & edge[1:]) + 1
    doc = np.searchsorted(off, first, side="right") - 1
    ends = np.concatenate([[0], np.cumsum(final - first)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[visible])))
    return raw, first, final, doc, words


class Tagger:
    """Tags texts in one worker; what it knows of tokens that aren't plain words is kept between batches."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}
        self.unknown = len(field.classes)

    def look(self, token: str) -> tuple[np.ndarray, int]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[token] = (self.field.score(token), self.field.classes.get(kind_of(token), self.unknown))
        return got

    def types(self, d: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For distinct tokens, scores and classes; plain words that look the same share theirs."""
        plain = np.asarray(pc.match_substring_regex(d, PLAIN))
        score, cls = np.zeros((len(d), len(TAGS)), np.float32), np.zeros(len(d), np.int32)
        words = d.filter(pa.array(plain))
        bare = pc.utf8_rtrim(words, ".,;:!?")
        key = np.asarray(pc.is_in(pc.utf8_lower(bare), value_set=pa.array(sorted(KEYWORDS), pa.large_string())))
        upper = np.asarray(pc.utf8_is_upper(bare))
        title = np.asarray(pc.match_substring_regex(bare, r"^\p{Lu}"))
        length = np.minimum(np.asarray(pc.utf8_length(bare)), 24) // 3
        look = np.asarray(pc.match_substring_regex(bare, r"^\p{Lu}+$")) * 1 + np.asarray(pc.match_substring_regex(bare, r"^\p{Lu}?[^\p{Lu}]+$")) * 2
        group = ((length * 2 + upper) * 2 + title) * 4 + look
        odd = key | (look == 0) | (upper & (length >= 5))
        at = np.flatnonzero(plain)
        uniq, where, back = np.unique(np.where(odd, -1 - np.arange(len(group)), group), return_index=True, return_inverse=True)
        got = [self.look(t) for t in bare.take(pa.array(where)).to_pylist()]
        if len(uniq):
            score[at], cls[at] = np.array([g[0] for g in got])[back], np.array([g[1] for g in got])[back]
        rest = np.flatnonzero(~plain)
        got = [self.look(t) for t in d.take(pa.array(rest)).to_pylist()]
        if len(rest):
            score[rest], cls[rest] = np.array([g[0] for g in got]), np.array([g[1] for g in got])
        return score, cls

    def tag(self, values: pa.Array):
        """Tokens as of tokens() and their tags.

        Sentences end with a line, or with a token that ends in . ! or ?. One in which every token's lead for O exceeds
        all that transitions could add is O throughout, whatever Viterbi would weigh; the others are decoded.
        """
        raw, first, final, doc, words = tokens(values)
        tags = np.zeros(len(first), np.int8)
        if not len(first):
            return raw, first, final, doc, tags
        d = words.dictionary_encode()
        code = np.asarray(d.indices)
        score, cls = self.types(d.dictionary)
        line = np.concatenate([[0], np.cumsum(raw == 10)])
        stop = np.isin(raw[final - 1], [33, 46, 63])
        new = np.r_[True, (doc[1:] != doc[:-1]) | (line[first[1:]] != line[final[:-1]]) | stop[:-1]]
        edge = self.unknown + 1
        c = cls[code]
        before, after = np.where(new, edge, np.r_[edge, c[:-1]]), np.where(np.r_[new[1:], True], edge, np.r_[c[1:], edge])
        f = self.field
        lead = lambda x: x[:, 0] - x[:, 1:].max(1)
        sure = lead(score)[code] + lead(f.prev_w)[before] + lead(f.after_w)[after] > f.slack
        sentence = np.cumsum(new) - 1
        doubt = np.bincount(sentence, weights=~sure) > 0
        at = np.flatnonzero(doubt[sentence])
        if len(at):
            emit = score[code[at]] + f.prev_w[before[at]] + f.after_w[after[at]]
            off = np.r_[np.flatnonzero(new[at]), len(at)]
            tags[at] = viterbi(emit, off, f)
        return raw, first, final, doc, tags


LEFT, RIGHT = b"\"'<[{", b"\"'>]}).,;:!?&%$#*|"


def spans(raw: np.ndarray, first: np.ndarray, final: np.ndarray, doc: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(text number, begin, end, kind) of every entity in bytes, without quotes and punctuation around it.

    Of a secret that has its name before = or :, only what follows is meant.
    """
    out = []
    for i in np.flatnonzero(tags % 2 == 1):
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1 and doc[j] == doc[i]:
            j += 1
        s, e, kind = int(first[i]), int(final[j - 1]), KINDS[(int(tags[i]) - 1) // 2]
        body = raw[s:e].tobytes()
        cut = body.lstrip(LEFT)
        s += len(body) - len(cut)
        cut = cut.rstrip(RIGHT)
        if kind == "SECRET" and (m := re.match(rb"\w+[=:]+[\"']?(?=.)", cut)):
            s, cut = s + m.end(), cut[m.end() :]
        if cut:
            out.append((int(doc[i]), s, s + len(cut), kind))
    return out


def masked(values: pa.Array, tagger: Tagger) -> tuple[dict[int, bytes], dict[int, list[tuple[int, int, str]]]]:
    """For the texts that have entities: the text with each as [KIND], and the entities' character offsets."""
    raw, first, final, doc, tags = tagger.tag(values)
    off = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    by: dict[int, list[tuple[int, int, str]]] = {}
    for d, s, e, k in spans(raw, first, final, doc, tags):
        by.setdefault(d, []).append((s, e, k))
    text, where = {}, {}
    for d, found in by.items():
        base = int(off[d] - off[0])
        body = raw[base : int(off[d + 1] - off[0])]
        char = np.cumsum((body & 0xC0) != 0x80)
        parts, at = [], 0
        for s, e, k in found:
            parts += [body[at : s - base].tobytes(), f"[{k}]".encode()]
            at = e - base
        text[d] = b"".join([*parts, body[at:].tobytes()])
        where[d] = [(int(char[s - base]) - 1, int(char[e - base - 1]), k) for s, e, k in found]
    return text, where


def replaced(values: pa.Array, text: dict[int, bytes]) -> pa.Array:
    """The array with some values replaced."""
    if not text:
        return values
    mask = np.zeros(len(values), bool)
    mask[list(text)] = True
    return pc.replace_with_mask(values, pa.array(mask), pa.array([text[i].decode() for i in sorted(text)], pa.large_string()))


def field_of(examples: DataFrame | None) -> Field:
    """The field trained on a labelled table (sentence, position, token, tag), or on the standard one.

    Rows with a null sentence, position or token are left out, unknown and null tags are O. Of rows that repeat a sentence
    and position the first by token, then tag, counts. Without any rows nothing is ever found.
    """
    if examples is None:
        return standard()
    some = examples.select("sentence", "position", "token", "tag").where("sentence is not null and position is not null and token is not null")
    rows: dict[tuple, tuple[str, str]] = {}
    for s, i, token, tag in some.collect():
        one = (token, tag if tag in TAGS else "O")
        rows[s, i] = min(one, rows.get((s, i), one))
    if not rows:
        never = np.where(np.arange(len(TAGS)) == 0, 0.0, NEVER)
        return Field({}, {}, {}, (allowed() + never).astype(np.float32), never.astype(np.float32))
    return train([(s, i, t, y) for (s, i), (t, y) in rows.items()])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: DataFrame | None = None) -> DataFrame:
    """(id, text, n_found, found) for every row: the text with each entity as [KIND], and found as KIND:begin-end, with commas.

    Offsets count characters of the original text. Null texts stay null with n_found 0, empty ones stay empty; whole texts
    of any length are read; repeated rows and null ids give rows of their own; other columns are ignored; an empty table
    gives none. Ids are whole numbers or texts of such; any other is an error. The labelled table is small: its rows are
    collected to train the field. The time of a text without any end of a sentence is in proportion to its length, but it
    is decoded word by word: some 6 s for a million characters that hold a doubtful word.
    """
    tune(docs.sparkSession)
    field = field_of(examples)
    slim = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    out = pa.schema([("id", pa.int64()), ("text", pa.large_string()), ("n_found", pa.int64()), ("found", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for b in slices(batches, "text", 4_000_000):
            values = texts(b, "text")
            text, where = masked(values.fill_null(""), tagger)
            n = np.zeros(len(values), np.int64)
            found = [""] * len(values)
            for i, w in where.items():
                n[i], found[i] = len(w), ",".join(f"{k}:{s}-{e}" for s, e, k in w)
            yield pa.RecordBatch.from_arrays([b.column(0), replaced(values, text), pa.array(n), pa.array(found, pa.large_string())], schema=out)

    return slim.mapInArrow(run, "id long, text string, n_found long, found string").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", examples: DataFrame | None = None) -> DataFrame:
    """docs with every entity in the text as [KIND], and the length column, if there is one, brought up to date.

    All other columns, null texts and repeated rows are as they were; an empty table stays empty.
    """
    tune(docs.sparkSession)
    field = field_of(examples)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be handed to a worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for b in slices(batches, f"c{at}", 4_000_000):
            values = texts(b, f"c{at}")
            text, _ = masked(values.fill_null(""), tagger)
            if text:
                columns = list(b.columns)
                columns[at] = replaced(values, text).cast(b.schema.field(at).type)
                if length is not None:
                    rows = np.zeros(len(values), bool)
                    rows[list(text)] = True
                    columns[length] = pc.if_else(pa.array(rows), pc.utf8_length(columns[at]).cast(b.schema.field(length).type), columns[length])
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data masked."""
    return find(load(spark, sf_dir, "documents"))
