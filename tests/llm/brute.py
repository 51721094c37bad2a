"""Plain versions of the operators' contracts, for tests."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(t):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    fp = {i: fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3]
    c = components(ids, pairs)
    return {i: (f"{fp[i]:016x}", c[i]) for i in ids}


def quality(t):
    w, t = words(t), t or ""
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines, seen = 0, set()
    for line in t.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(hit), n < 10 or 100 * len(hit) > 20 * n


def substrings(rows, size=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(i, first.get(x, i))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def targets(sizes):
    """{source: target} of {source: size}, by resharing what is above a cap until nothing is."""
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, capped, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            capped.add(s)
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def vectors(rows):
    """{id: (links, component)} for [(id, vector)] with unique ids."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    pairs = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95]
    n = defaultdict(int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    c = components([i for i, _ in rows], pairs)
    return {i: (n[i], c[i]) for i, _ in rows}


def viterbi(lines, m):
    """The likeliest (role, starts a turn) of each line; ``lines``: (marker kind, features).  Every path's probability, line by line, in a table of dicts."""
    states = [(r, new) for new in (True, False) for r in range(3)]

    def shown(state, line):
        (r, new), (kind, bits) = state, line
        p = (m.bare_start, *(m.named if k == r else m.wrong for k in range(3)), m.unnamed)[kind] if new else (m.inside, *[m.marked_inside] * 4)[kind]
        for bit, q in ((1, m.question), (2, m.blank), (4, m.long)):
            q = q[r] if new else q[3]
            p *= q if bits & bit else 1 - q
        return math.log(p)

    def moved(a, b):
        if b[1]:
            return math.log(m.turn_ends) + math.log(m.following[a[0]][b[0]])
        return math.log(1 - m.turn_ends) if a[0] == b[0] else -math.inf

    best = {s: (math.log(m.first[s[0]]) + shown(s, lines[0]) if s[1] else -math.inf, [s]) for s in states}
    for line in lines[1:]:
        best = {s: max(((best[a][0] + moved(a, s) + shown(s, line), [*best[a][1], s]) for a in states), key=lambda x: x[0]) for s in states}
    return max(best.values(), key=lambda x: x[0])


def folded(text, lookalikes, signs):
    """Words of a text as a scorer reads them, letter by letter."""
    import unicodedata

    plain = ""
    for c in unicodedata.normalize("NFKC", text):
        if 0x300 <= ord(c) <= 0x36F:
            continue
        if 0xFF01 <= ord(c) <= 0xFF5E:
            c = chr(ord(c) - 0xFEE0)
        plain += "" if c in "​‌‍­﻿" else lookalikes.get(c, c)
    letter = lambda c: c.isalnum() and not c.isdecimal()
    runs = "".join(c if c.isalnum() or c in "@$!" else " " for c in plain.lower()).split(" ")
    out = []
    for run in runs:
        beside = any((letter(a) and (b in "@$" or b in "0123456789")) or ((a in "@$!" or a in "0123456789") and letter(b)) for a, b in zip(run, run[1:], strict=False))
        readings = [run]
        if beside:
            core = run.rstrip("!")
            readings = list(dict.fromkeys("".join(signs.get(c, c) for c in x) for x in (core, core.strip("0123456789@$!"))))
        for x in readings:
            out += "".join(c if letter(c) else " " for c in x).split()
    return " " + " ".join(out) + " "


def _second(text, clean, lookalikes):
    """(word, other readings) of words with accents, and of single letters in a row."""
    import unicodedata

    bare = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    out = [(w, bare(w)) for w in clean.split() if bare(w) != w]
    kept = "".join("" if 0x300 <= ord(c) <= 0x36F or c in "\u200b\u200c\u200d\u00ad\ufeff" else lookalikes.get(c, c) for c in unicodedata.normalize("NFKC", text)).lower()
    letter = lambda c: c.isalnum() and not c.isdecimal()
    k = 0
    while k < len(kept):
        end = k
        if letter(kept[k]) and (k == 0 or not kept[k - 1].isalnum()):
            while end + 2 < len(kept) and not kept[end + 1].isalnum() and letter(kept[end + 2]):
                end += 2
            while end > k and end + 1 < len(kept) and kept[end + 1].isalnum():
                end -= 2
        if end - k >= 4:
            joined = "".join(c for c in kept[k : end + 1] if c.isalpha())
            out.append(("", f"{joined} {joined[1:]} {joined[:-1]}"))
            k = end
        k += 1
    return out


def toxicity(text, model, lookalikes, signs):
    """The score of a text by looking for every entry at every place."""
    clean = folded(text or "", lookalikes, signs)
    found = _hits(clean, model)
    for first, second in _second(text or "", clean, lookalikes):
        more = sum(_hits(f" {second} ", model).values())
        if more > 0:
            found[len(found), second] = max(0.0, more - sum(_hits(f" {first} ", model).values()))
    weight = math.fsum(found.values()) / (1 + math.log1p(len(clean) / 6 / model.length_scale)) if text else 0.0
    return 1 / (1 + math.exp(-(model.bias + model.slope * weight)))


def _hits(clean, model):
    places = lambda x: [k for k in range(len(clean)) if clean.startswith(x, k)]
    excused = [(k, k + len(p) + 2) for p in model.exceptions for k in places(f" {p} ")]
    best = {}
    for entry, w in model.lexicon:
        for k in places(entry):
            if not any(a <= k and k + len(entry) <= z for a, z in excused):
                best[k] = max(w, best.get(k, 0.0))
    return best


def learned(rows, s, features):
    """(lexicon, its log odds) of labelled texts (text, toxic) by counting ``features`` of each text; see the operator's text."""
    n, bad = Counter(), Counter()
    for text, y in rows:
        n.update(features(text))
        bad.update(features(text) if y > 0 else ())
    total, toxic = len(rows), sum(y > 0 for _, y in rows)
    prior = toxic / (total - toxic)
    odds = {f: math.log((bad[f] + 0.5 * prior) / (n[f] - bad[f] + 0.5) / prior) for f in bad if bad[f] >= s.least_rows}
    top = sorted((f for f in odds if odds[f] >= s.least_odds), key=lambda f: (-odds[f], f))[: s.entries]
    top = [f for f in top if max((bad[g] for g in top if g != f and g.startswith(f)), default=0) < 0.9 * bad[f]]
    kept = {}
    for f in sorted(top, key=lambda f: (len(f), f)):
        if all(kept[g] < odds[f] - 1.0 for g in kept if f.startswith(g)):
            kept[f] = round(odds[f], 4)
    return kept


def bands(data, b):
    """Whether zstandard ratios of the whole and of its chunks lie within the limits."""
    import zstandard

    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=b.level).compress(x))
    limit, other = None, 100 * sum(x >= 128 for x in data) >= b.other_percent * max(1, len(data))
    for least, low, high in b.other if other else b.whole:
        if len(data) >= least:
            limit = low, high
    if limit is None:
        return True
    if not limit[0] <= ratio(data) <= limit[1]:
        return False
    low, high = b.other_chunk if other else b.chunk
    if len(data) <= b.chunk_bytes:
        return len(data) < b.chunk_bytes or low <= ratio(data) <= high
    full = len(data) // b.chunk_bytes
    chunks = [data[k * b.chunk_bytes : (k + 1) * b.chunk_bytes] for k in range(full)] + [data[-b.chunk_bytes :]]
    return all(low <= ratio(x) <= high for x in chunks)


def sainte_lague(wishes, total):
    """Seats one by one to the highest quotient; ties to the first."""
    out = dict.fromkeys(wishes, 0)
    for _ in range(total):
        if not any(wishes.values()):
            break
        best = max(wishes, key=lambda k: wishes[k] / (2 * out[k] + 1))
        out[best] += 1
    return out


def _byte_letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_spans(text):
    """(id, start, end) of each token of both tokenizers over the bytes of a space and the text; none if either does not give those back."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, out = _byte_letters(), ([], [])
    if text:
        a = whole.encode(" " + text, add_special_tokens=False)
        first = [(i, bytes(letters[c] for c in s)) for i, s in zip(a.ids, a.tokens, strict=True)]
        second = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("\u2581", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
        if all(b"".join(x for _, x in t) == (" " + text).encode() for t in (first, second)):
            for t, o in zip((first, second), out, strict=True):
                at = 0
                for i, x in t:
                    o.append((i, at, at + len(x)))
                    at += len(x)
    return out


def alignment(rows):
    per, count, best = {}, Counter(), {}
    for doc, text in rows:
        a, b = token_spans(text)
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        said, x, y = [], 0, 0
        for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            left, right = [], []
            while x < len(a) and a[x][2] <= end:
                left.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= end:
                right.append(str(b[y][0]))
                y += 1
            said.append(f"{','.join(left)}|{','.join(right)}")
        count.update(links)
        per[doc] = len(a), len(b), links, said
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return {
        d: (na, nb, len(s), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(s).encode()).hexdigest() if s else "")
        for d, (na, nb, p, s) in per.items()
    }


def personal_base(text):
    """(kind, start, end) of the four patterns as they are written, by start and kind."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(out)]


def spelling(rows):
    """word: (form, root, n, n_near, form_n) by comparing all pairs of words."""
    import zlib

    lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    count = Counter()
    for doc, text in rows:
        for w in map(lower, re.findall("[A-Za-z\u00C0-\u00FF]+", text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, number = {}, {}
    for w in n:
        by = sorted((-n[x], x) for x in n if x != w and near(w, x))
        number[w] = len(by)
        form[w] = by[0][1] if by and -by[0][0] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], number[w], n[form[w]] if form[w] else None) for w in n}
