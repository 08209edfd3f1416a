"""Plain definitions of the operators' contracts, one row at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def next_texts(docs: list[tuple]) -> dict:
    """doc_id -> text of the next row in descending order of doc_id (unique ids)."""
    ids = sorted((d for d, *_ in docs), reverse=True)
    text = {d: t or "" for d, t, *_ in docs}
    return {d: text[ids[(i + 1) % len(ids)]] for i, d in enumerate(ids)}


def edited(text: str | None, following: str) -> str:
    text = text or ""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def edited_sha256(text: str | None, following: str) -> str:
    return hashlib.sha256(edited(text, following).encode()).hexdigest()


def simhash(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints: list[tuple]) -> dict:
    """fingerprint -> smallest id among all fingerprints that it reaches by at most two differing bits."""
    points = sorted({f for _, f in prints})
    root = {f: f for f in points}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for d, f in prints:
        if d is not None and (low[find(f)] is None or d < low[find(f)]):
            low[find(f)] = d
    return {f: low[find(f)] for f in points}


def size_in_words(text: str | None) -> int:
    return len(WORD.findall(text or ""))


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2) -> dict:
    """Shares by weight, stopped at the cap, the excess shared again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        out = {s: cap * float(sizes[s]) for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


def top_k(vectors: list[tuple], k=5, every=50) -> list[tuple]:
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted(dict(x for x in sound if x[0] % every == 0).items()):
        found = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q and len(b) == len(a)})
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(found)]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def entropy(candidate: str, window: int) -> float:
    """Most bits a character of any window."""
    best = 0.0
    for i in range(len(candidate) - window + 1):
        part = candidate[i : i + window]
        best = max(best, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
    return best


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def crc_mod(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def _mix64(x: int) -> int:
    top = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
    x = (x ^ x >> 27) * 0x94D049BB133111EB & top
    return x ^ x >> 31


_GOLDEN, _TOP = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _toss(labels: list[int]) -> list[int]:
    """Twice the lowest bit in which a symbol differs from its left neighbour, plus that bit; the first one's lowest bit."""
    out = [labels[0] & 1]
    for left, own in zip(labels, labels[1:]):
        low = ((own ^ left) & -(own ^ left)).bit_length() - 1
        out.append(2 * low + (own >> low & 1))
    return out


def phrases(text: str) -> list[tuple[int, int, str]]:
    """(level, name, phrase as a string) of every phrase of a text, a symbol at a time."""
    level, out = 0, []
    symbols = [(ord(c), c) for c in text]
    while symbols and (level == 0 or len(symbols) > 1):
        level += 1
        runs: list[list] = []
        for name, part in symbols:
            if runs and runs[-1][0] == name:
                runs[-1][1:] = [runs[-1][1] + part, runs[-1][2] + 1]
            else:
                runs.append([name, part, 1])
        symbols = [(_mix64((name + n * _GOLDEN) & _TOP) if n > 1 else name, part) for name, part, n in runs]
        labels = _toss(_toss(_toss([name for name, _ in symbols])))
        begins = [0] + [i for i in range(1, len(labels) - 1) if labels[i] < labels[i - 1] and labels[i] < labels[i + 1]]
        merged = []
        for a, b in zip(begins, [*begins[1:], len(symbols)]):
            total = sum(_mix64((name + i * _GOLDEN) & _TOP) for i, (name, _) in enumerate(symbols[a:b])) & _TOP
            merged.append((_mix64(total), "".join(part for _, part in symbols[a:b])))
        symbols = merged
        out += [(level, name, part) for name, part in symbols]
    return out


def phrase_sketch(text: str | None, size: int = 64) -> list[float]:
    """The smallest exponential ranks of a text's phrases, by weight of their lengths."""
    found = set()
    for level, name, part in phrases(text or ""):
        hashed = _mix64((name + level * _GOLDEN) & _TOP)
        found.add(-math.log(((hashed >> 11) + 0.5) / 2**53) / min(len(part) / 8, 1) ** 3)
    return sorted(found)[:size]


def phrase_likeness(a: str, b: str) -> float:
    """Exact share of the common weight of two texts' phrases."""
    x, y = ({(level, part): min(len(part) / 8, 1) ** 3 for level, _, part in phrases(t)} for t in (a, b))
    union = x | y
    return sum(w for k, w in union.items() if k in x and k in y) / sum(union.values()) if union else 1.0


def best_fit(lengths: list[int], capacity: int) -> int:
    """Number of sequences when each piece, longest first, goes where the least room is left that holds it."""
    room: list[int] = []
    for n in lengths:
        fitting = [r for r in room if r >= n]
        if fitting:
            room.remove(min(fitting))
        room.append((min(fitting) if fitting else capacity) - n)
    return len(room)


def _keyed(key: str, *parts) -> int:
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(a: int, b: int, a_mod: int, b_mod: int, key: str, tweak: str) -> tuple[int, int]:
    for i in range(8):
        if i % 2 == 0:
            a = (a + _keyed(key, tweak, i, b)) % a_mod
        else:
            b = (b + _keyed(key, tweak, i, a)) % b_mod
    return a, b


def permuted_digits(digits: str, key: str, tweak: str) -> str:
    n, left = len(digits), len(digits) // 2
    a, b = feistel(int(digits[:left]), int(digits[left:]), 10**left, 10 ** (n - left), key, f"{tweak}:{n}")
    return f"{a:0{left}}{b:0{n - left}}"


def _refilled(form: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def pseudonym(kind: str, value: str, key: str) -> str:
    """What a value becomes; dates are year first or, with slashes, day first."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        body = permuted_digits(digits[:-1], key, "card")
        return _refilled(value, next(body + c for c in "0123456789" if luhn(body + c)))
    if kind in ("ssn", "phone"):
        prefix = re.match(r"\+\d{1,3}(?=[ .(-])", value)[0] if value.startswith("+") else ""
        rest = value[len(prefix) :]
        return prefix + _refilled(rest, permuted_digits("".join(c for c in rest if c.isdigit()), key, kind))
    if kind == "ip":
        p = list(map(int, value.split(".")))
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        from datetime import date, timedelta

        day = date.fromisoformat(value) if "-" in value else date(*map(int, reversed(value.split("/"))))
        a, b = feistel(*divmod((day - date(1800, 1, 1)).days, 773), 189, 773, key, "date")
        new = date(1800, 1, 1) + timedelta(a * 773 + b)
        return new.isoformat() if "-" in value else f"{new.day:02}/{new.month:02}/{new.year:04}"
    raise ValueError(kind)


def language_model(rows: list[tuple[str | None, str]]) -> tuple[list[str], list[list[float]], list[float]]:
    """Languages, log probability of each bucket by language, log priors; of (text, lang)."""
    languages = sorted({lang for _, lang in rows})
    counts = {k: [0.5] * (1 << 15) for k in languages}
    for text, lang in rows:
        for b in gram_buckets(text):
            counts[lang][b] += 1
    prior = [math.log((sum(x == k for _, x in rows) + 1) / (len(rows) + len(languages))) for k in languages]
    return languages, [[math.log(c / total) for c in counts[k]] for k in languages for total in [sum(counts[k])]], prior


def gram_buckets(text: str | None) -> list[int]:
    """Buckets of the n-grams of one to four characters of the lower-cased letters between single spaces."""
    kept = re.sub(r"[\W\d_]+", " ", text or "").strip().lower()
    if not any(map(str.isalpha, kept)):
        return []
    kept, out = f" {kept} ", []
    for n in (1, 2, 3, 4):
        for i in range(len(kept) - n + 1):
            h = 0
            for c in kept[i : i + n]:
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
            out.append((((h ^ h >> 15) * 0x85EBCA6B + n) & 0xFFFFFFFF) >> 17)
    return out


def language(text: str | None, model) -> tuple[str, float]:
    found = gram_buckets(text)
    languages, table, prior = model
    if not found or not languages:
        return "und", 0.0
    total = [sum(t[b] for b in found) / 4 + p for t, p in zip(table, prior)]
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    return languages[best], 1 / sum(math.exp(x - total[best]) for x in total)
