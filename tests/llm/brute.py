"""Plain Python versions of the operators, by their definitions."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reachable(n, pairs):
    """Index sets as the smallest index per node."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def least_ids(ids, roots):
    least = {}
    for i, r in zip(ids, roots):
        if i is not None and (r not in least or i < least[r]):
            least[r] = i
    return [least.get(r) for r in roots]


def warc(pages):
    lead = {}
    for page_id, html in pages:
        p = html or ""
        if p not in lead or (page_id is not None and (lead[p] is None or page_id > lead[p])):
            lead[p] = page_id
    out = []
    for page_id, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and page_id != lead[html or ""]
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response",
                    lead[html or ""] if again else None))
    return out


def embeddings(rows, cosine=0.93):
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
           and label is not None for _, v, label in rows]
    scaled = [np.array(v, float) / max(map(abs, v)) if f else None for f, (_, v, _) in zip(fit, rows)]
    unit = [x / np.linalg.norm(x) if f else None for f, x in zip(fit, scaled)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if fit[i] and fit[j] and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine]
    n = Counter(x for p in pairs for x in p)
    comp = least_ids([r[0] for r in rows], reachable(len(rows), pairs))
    return [(r[0], n[i], comp[i], r[0] == comp[i]) for i, r in enumerate(rows)]


def quality(text, ngrams={5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}, lines=20):
    ws = words(text)
    chars = [len(w) for w in ws]
    grams = {n: [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)] for n in {*ngrams, 8}}
    many = Counter(grams[8])
    repeated = {i + j for i, g in enumerate(grams[8]) if many[g] > 1 for j in range(8)}
    parts = [x for x in (text or "").split("\n") if words(x)]
    seen, dup, dup_chars, many_chars = set(), 0, 0, 0
    for line in parts:
        if line in seen:
            dup += 1
            dup_chars += sum(map(len, words(line)))
            many_chars += sum(map(len, words(line))) * (parts.count(line) > 2)
        seen.add(line)
    held = {"dup_line_chars": dup_chars, "many_line_chars": many_chars}
    for n in sorted(ngrams):
        times = Counter(grams[n])
        for name, least in (("dup", 2), ("many", 3)):
            known, cover = set(), set()
            for i, g in enumerate(grams[n]):
                if g in known and times[g] >= least:
                    cover |= set(range(i, i + n))
                known.add(g)
            held[f"{name}_{n}gram_chars"] = sum(chars[i] for i in cover)
    total = sum(chars)
    failed = len(ws) < 20 or 100 * len(repeated) > 30 * len(ws)
    kept = not failed and all((held[f"dup_{x}_chars"] + held[f"many_{x}_chars"]) / 2 * 100 <= limit * total
                              for x, limit in {"line": lines, **{f"{n}gram": p for n, p in ngrams.items()}}.items())
    return {"n_words": len(ws), "word_chars": total, "n_symbols": sum(c in "#*$%&|<>" for w in ws for c in w),
            "n_dup_lines": dup, "n_repeat_words": len(repeated), **held, "base_failed": failed, "kept": kept}


def fingerprint(text, shingle=4):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + shingle]) for i in range(max(1, len(ws) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, radius=4):
    fps = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(fps))
    near = np.array(distinct, np.uint64)
    pairs = []
    for i, f in enumerate(near):
        bits = np.bitwise_count(near[:i] ^ f) if i else np.zeros(0)
        pairs += [(i, int(j)) for j in np.flatnonzero(bits <= radius)]
    roots = dict(zip(distinct, reachable(len(distinct), pairs)))
    comp = least_ids([d for d, _ in docs], [roots[f] for f in fps])
    return [(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, comp)]


def substring(docs, span=20):
    """docs: (id, text), order by id (None first) and text hash like the operator for equal ids."""
    parsed = [(d, words(t)) for d, t in docs]
    first = {}
    for k, (d, ws) in enumerate(parsed):
        for i in range(len(ws) - span + 1):
            key, place = tuple(ws[i:i + span]), (d is not None, d or 0, docs[k][1], i)
            if key not in first or place < first[key]:
                first[key] = place
    out = []
    for k, (d, ws) in enumerate(parsed):
        gone = set()
        for i in range(len(ws) - span + 1):
            if (d is not None, d or 0, docs[k][1], i) > first[tuple(ws[i:i + span])]:
                gone |= set(range(i, i + span))
        out.append((d, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def segment(role, text):
    role = (role or "").replace("\\", "\\\\").replace("\n", "\\n")
    return re.sub(r"<(\\*)\|", r"<\\\1|", role) + "\n" + re.sub(r"<(\\*)\|", r"<\\\1|", text or "") + "<|im_end|>\n"


def chat(rows):
    """rows: (conv, turn, role, text); equal turns of a conversation follow by their segments."""
    out = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, segment(r[2], r[3])))
    for conv, _, role, text in order:
        state = out.setdefault(conv, [0, "", "", 0])
        role, text = role or "", text or ""
        state[0] += 1
        state[1] += f"{role}\n{text}\n"
        if role == "assistant":
            state[2] += text
        shown = len(re.findall(r"<\\*\|", text)) + len(text)
        named = role.replace("\\", "\\\\").replace("\n", "\\n")
        state[3] += len("<|im_start|>") + len(named) + len(re.findall(r"<\\*\|", named)) + 1 + shown + len("<|im_end|>\n")
    return {(c, n, sha(a), len(b), sha(b), f) for c, (n, a, b, f) in out.items()}


def hashed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def merkle(rows, arity=3):
    """rows: (name of the group, order, leaf) -> per row (subroot, root, [(left, right), ...] up to the root)."""
    def climb(nodes):
        """(root, steps per leaf)"""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
            for k, i in enumerate(at):
                run, place = runs[i // arity], i % arity
                steps[k].append(("".join(run[:place]), "".join(run[place + 1:])))
                at[k] = i // arity
            nodes = [sha("".join(r)) for r in runs]
        return nodes[0], steps

    groups = {}
    for i, (name, order, leaf) in enumerate(rows):
        groups.setdefault(name, []).append((order is not None, order or 0, leaf, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([r[2] for r in sorted(groups[g])]) for g in names}
    root, tops = climb([trees[g][0] for g in names])
    out = [None] * len(rows)
    for g, top in zip(names, tops):
        for r, steps in zip(sorted(groups[g]), trees[g][1]):
            out[r[3]] = (trees[g][0], root, steps + top)
    return out


def trie(convs):
    """convs: (id, [(turn, size), ...]) -> a row per distinct prefix."""
    members = {}
    for i, c in convs:
        for k in range(len(c) + 1):
            members.setdefault(tuple(c[:k]), []).append((i, len(c) == k))
    kids, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for k in range(len(p) + 1):
            leaves[p[:k]] += not kids[p]
            saved[p[:k]] += (len(m) - 1) * p[-1][1] if p else 0
    low = {p: min(i for i, _ in m) for p, m in members.items()}
    return [(low[p], len(p), low[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p],
             sha(",".join(str(i) for i in sorted(i for i, end in m if end)))) for p, m in members.items()]


def rebuilt(rows):
    """rows: (conv, turn, role, text) -> (conv, [((role, text), bytes), ...])"""
    own = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = sha(f"{len(role.encode())}:{role}{text}")[:32]
        own.setdefault(conv, []).append((turn is not None, turn or 0, digest, ((role, text), len(text.encode()))))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items() if c is not None}
    out = []
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out.append((c, own.get(base, [])[:h] + ts[h:]))
    return out


def fits(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def nearest(rows, asked, k=20):
    """rows: (id, vector) -> {(id, vector): [(score, id), ...]}, the true k nearest."""
    rows = {(i, tuple(0.0 + x for x in v)) for i, v in rows if i is not None and fits(v)}
    out = {}
    for i, q in rows:
        if asked(i):
            found = [(-float(np.dot(q, v)), j) for j, v in rows if j != i and len(v) == len(q)]
            out[i, q] = [(-s, j) for s, j in sorted(found)[:k]]
    return out


def license_places(words, templates, fixed, share=0.1):
    """{(license, first word, last word)} of every place where a template stands, by word edits alone: at most a tenth of its
    words lack, as many are added, no fixed word among either, nor in the place of lacking first or last words.
    words: of the text; templates: (name, words)."""
    out = set()
    for name, want in templates:
        limit = int(share * len(want))
        for first in range(len(words)):
            cells, seen = {(0, 0, 0, 0, 0)}, set()  # template words done, lacking, added, lacking at its head and its end
            while cells:
                i, lost, more, head, tail = cell = cells.pop()
                if cell in seen:
                    continue
                seen.add(cell)
                j = first + i - lost + more
                if i == len(want):
                    if not any(map(fixed, [*words[max(0, first - head):first], *words[j:j + tail]])):
                        out.add((name, first, j))
                    continue
                if j < len(words) and words[j] == want[i]:
                    cells.add((i + 1, lost, more, head, 0))
                if lost < limit and not fixed(want[i]):
                    cells.add((i + 1, lost + 1, more, head + (i == head), tail + 1))
                if j < len(words) and i > head and more < limit and not fixed(words[j]):
                    cells.add((i, lost, more + 1, head, tail))
    return out
