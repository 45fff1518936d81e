"""Plain Python versions of the training-data operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def warc(pages):
    """{id: (bytes, digest, type, refers_to)} of {id: payload}."""
    data = {k: (v or "").encode() for k, v in pages.items()}
    last = {}
    for k, v in data.items():
        last[v] = max(k, last.get(v, k))
    return {
        k: (len(v), base64.b32encode(hashlib.sha1(v).digest()).decode(), "response" if last[v] == k else "revisit", None if last[v] == k else last[v])
        for k, v in data.items()}


def shingle_set(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def near_duplicates(texts, width, percent=80):
    """{id: (size, component, kept)} of {id: text}."""
    sets = {k: shingle_set(t, width) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for a in sorted(sets):
        common = Counter(b for s in sets[a] for b in lists[s])
        for b, i in common.items():
            if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
        for s in sets[a]:
            lists[s].append(a)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(texts, items, width=10):
    """{id: (n_words, n_hit, n_items, digest, contaminated)}."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORDS.findall(lower(text))
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for k, text in texts.items():
        words, hit, found = WORDS.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out[k] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


# the contract's patterns, letter by letter in either case
ASSIGN = re.compile(
    "(" + "|".join("".join(c if c in "_?" else f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    """(n_assign, n_access, n_hex, digest)."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    n = Counter(s[1] for s in spans)
    line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return n[0], n[1], n[2], hashlib.sha256(line.encode()).hexdigest()


def token_rows(texts, tokenizer, end_id=1):
    """{id: (start, n_tokens, crc)} in ascending order of id."""
    out, at = {}, 0
    for k in sorted(texts):
        ids = tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [end_id]
        out[k] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    return out


def signatures(text, anchors):
    """How many signatures a text has, and their chains."""
    words = [w for w in re.split(r"[\W_]+", lower(text)) if w]
    content = [w for w in words if w not in anchors]
    out, before = set(), 0
    for w in ["^", *words]:
        if w == "^" or w in anchors:
            if content[before : before + 1]:
                out.add((w, *content[before : before + 2]))
        else:
            before += 1
    return out or ({tuple(words)} if words else {text} if text else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def without_repeats(texts, width=35):
    """{id: (n_words, n_removed, digest)}: words under windows that begin at several places go."""
    words = {k: re.findall("[^\x20\x09-\x0d]+", t or "") for k, t in texts.items()}
    starts = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - width + 1) if starts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def toxic_features(text, weights, exceptions, fold):
    """(log of the sum, sum per root of words): at each beginning of a word its heaviest pattern, without excepted phrases."""
    folded, total = fold(text or ""), 0.0
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\W_]+", folded)]
    for begin in range(len(folded)):
        if begin and folded[begin - 1].isalnum():
            continue
        best = 0.0
        for pattern, weight in weights.items():
            bare = pattern.removesuffix("*")
            end = begin + len(bare)
            if folded.startswith(bare, begin) and pattern.endswith("*") == (end < len(folded) and folded[end].isalnum()):
                best = max(best, weight)
        at = [i for i, (start, _) in enumerate(words) if start == begin]
        if best and at:
            here = words[at[0]][1]
            pairs = [f"{here} {w[1]}" for w in words[at[0] + 1 : at[0] + 2]] + [f"{w[1]} {here}" for w in words[at[0] - 1 : at[0]] if at[0]]
            best = 0.0 if set(pairs) & exceptions else best
        total += best
    return math.log1p(total), total / math.sqrt(len(folded.split()) + 20)


def audit(docs, labels):
    """{(part, order, step): counts} of (id, text, part) rows, by applying the filters in every order."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and first[text] < i else set()
        rows.append((part or "", fails, *(any(r[0] == i is not None and r[c] == 1 for r in labels) for c in (1, 2))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                own = [r for r in mine if f in r[1]]
                total[f] += len(lost)
                out[part, order, step] = [len(left), len(lost), len(own) - len(lost), sum(r[1] == {f} for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def whitened(vectors, components=4):
    """n, and {id: (deviation, whitened)} and shares of variance of {id: list of numbers}."""
    import numpy as np

    good = {k: v for k, v in vectors.items() if v and all(c is not None and math.isfinite(c) for c in v)}
    x = {k: [math.floor(256 * float(c)) for c in v] for k, v in good.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    real = values > 1e-12 * max(values.max(), 1e-300)
    values, axes = values[real], axes[:, real]
    rows = {k: (sum((n * c - int(s)) ** 2 for c, s in zip(v, sums, strict=True)), (np.array(v) - sums / n) @ axes / np.sqrt(values)) for k, v in x.items()}
    return n, rows, values / np.trace(covariance)
