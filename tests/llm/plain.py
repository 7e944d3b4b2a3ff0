"""Plain versions of the contracts, and a small corpus with copies, near copies, passages and odd rows."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": "the ing and tion her for was".split(), "de": "sch ung keit der ein ich auf".split(), "fr": "eau eux ment que les ion oi".split()}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(seed=1, n=40):
    """(doc_id, text, lang, source, n_chars) rows."""
    r = random.Random(seed)
    passage = sentence(r, "en", 60)
    texts = [sentence(r, r.choice(list(SYLLABLES)), r.randrange(60, 200)) for _ in range(n)]
    base = texts[0].split()
    for i in range(6):  # a family of near copies
        words = base[:]
        words[r.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1]]  # exact copies
    texts += [f"{sentence(r, 'en', 90)}\n{passage}\n{sentence(r, 'de', 80)}" for _ in range(3)]
    texts += ["loop " * 90, "a b c", "a b c", "one", "", None, "  \n\t ", "### $$$ " * 40, sentence(r, "en", 30) + "\n" + sentence(r, "en", 40)]
    langs = [None if t is None else r.choice(["en", "de", None]) for t in texts]
    return [(i, t, langs[i], f"src{i % 2}" if i % 7 else None, len(t) if t else 0) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_components(rows):
    """doc_id -> (set size, smallest linked doc_id) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def without_repeats(texts, size=35):
    """Per text: its words, and which of them stay."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in all_words for i in range(len(w) - size + 1))
    out = []
    for w in all_words:
        stay = [True] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                stay[i : i + size] = [False] * size
        out.append((w, stay))
    return out


def cut(text, stay):
    """The text with each removed word and the white space after it cut out."""
    if text is None:
        return None
    spots = list(WORD.finditer(text))
    if not spots:
        return text
    ends = [m.start() for m in spots[1:]] + [len(text)]
    return text[: spots[0].start()] + "".join(text[m.start() : e] for m, e, s in zip(spots, ends, stay, strict=True) if s)


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
