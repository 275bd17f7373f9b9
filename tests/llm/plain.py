"""Plain versions of the operators, over lists, to hold the Spark ones against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeated_bytes(texts):
    """Per text (in order) its bytes, removed bytes, runs and the hash of the rest."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def shingles(text):
    words = WORD.findall(lower(text))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(5))))


def groups(rows):
    """Component of each (id, text): smallest id that links of similarity 0.8 reach."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        common = Counter(j for x in sets[i] for j in holders[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def base_scores(rows, folds=7, left_out=2):
    """Per id: held out, tokens, known tokens, and the unigram score; and N."""
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % folds == left_out for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n = sum(counts.values())
    whole = n + len(counts) + 1
    return n, {
        i: (out[i], len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / whole) for w in ws))
        for i, ws in tokens.items()
    }


def languages(learned, texts, unseen=0.01):
    """Word-first backoff with dicts: language and share of the likelihood per text."""
    letters = re.compile(r"[^\W\d_]+")
    learned = [(t, x) for t, x in learned if t is not None and x is not None]
    names = sorted({x for _, x in learned})
    prior = Counter(x for _, x in learned)
    words = {x: Counter() for x in names}
    for t, x in learned:
        words[x].update(letters.findall(t.lower()))
    grams = {x: Counter() for x in names}
    for x in names:
        for w in words[x]:
            marked = f"\x02{w}\x03"
            grams[x].update(marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1))

    def scorer(counts, kinds):
        total = {x: max([1] + [sum(c for k, c in counts[x].items() if len(k) == n) for n in kinds]) for x in names}
        if kinds == [0]:
            total = {x: max(1, sum(counts[x].values())) for x in names}
        every = set().union(*counts.values())
        absent = unseen / max(1, len(every))
        return every, lambda k: [math.log((1 - unseen) * counts[x][k] / total[x] + absent) for x in names]

    known_words, of_word = scorer(words, [0])
    known_grams, of_gram = scorer(grams, [1, 2, 3, 4])

    def score(w):
        if w in known_words:
            return of_word(w)
        marked = f"\x02{w}\x03"
        for n in (4, 3, 2, 1):
            found = [marked[i : i + n] for i in range(len(marked) - n + 1)]
            found = [of_gram(g) for g in found if g in known_grams]
            if found:
                return [sum(column) / len(found) for column in zip(*found)]
        return [0.0] * len(names)

    out = []
    for t in texts:
        counts = Counter(letters.findall((t or "").lower()))
        if not counts:
            out.append(("und", 0.0))
            continue
        total = [math.log(prior[x] / len(learned)) for x in names]
        for w, n in counts.items():
            total = [a + n * b for a, b in zip(total, score(w))]
        best = max(total)
        out.append((names[total.index(best)], 1 / sum(math.exp(a - best) for a in total)))
    return out


def hidden_markov(texts, class_of, first, classes, parts, tolerance):
    """log10 probabilities of texts, (id, words) each, one text and one word after the other.

    ``class_of`` gives the class of a word and its count; ``first`` start, step and
    emissions before the first round.
    """
    taught = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts]
    counts = Counter(w for t, (_, words) in zip(taught, texts) if t for w in words)
    kind = {w: class_of(w, counts[w]) for _, words in texts for w in words}
    unseen = classes - 2
    weight = [0.0] * classes
    for w, c in counts.items():
        weight[kind[w]] += c + 1
    weight[unseen] += 1
    share = [x + 1e-3 for x in weight]
    share[unseen] += sum(c for w, c in counts.items() if kind[w] < parts)
    share = [x / sum(share) for x in share]
    start, step, emit = first(share)
    states = range(len(start))

    def forward(words):
        rows, logs = [], 0.0
        for t, w in enumerate(words):
            moved = [sum(rows[-1][0][a] * step[a][s] for a in states) for s in states] if t else start
            row = [x * e for x, e in zip(moved, emit[kind[w]])]
            logs += math.log(sum(row))
            rows.append(([x / sum(row) for x in row], sum(row)))
        return rows, logs

    reached, gain, rounds = -math.inf, math.inf, 0
    while gain > tolerance:
        rounds += 1
        logs, n = 0.0, 0
        new = [[x] * len(states) for x in share]
        starts, steps = [1e-2] * len(states), [[1e-2] * len(states) for _ in states]
        for t, (_, words) in zip(taught, texts):
            if not t:
                continue
            rows, own = forward(words)
            logs, n = logs + own, n + len(words)
            back = [1.0] * len(states)
            for i in range(len(words) - 1, -1, -1):
                row, size = rows[i]
                for s in states:
                    new[kind[words[i]]][s] += row[s] * back[s]
                    starts[s] += row[s] * back[s] if i == 0 else 0.0
                ahead = [emit[kind[words[i]]][s] * back[s] / size for s in states]
                for a in states if i else ():
                    for b in states:
                        steps[a][b] += rows[i - 1][0][a] * step[a][b] * ahead[b]
                back = [sum(step[a][b] * ahead[b] for b in states) for a in states]
        gain, reached = logs / n - reached, logs / n
        for s in states:
            new[unseen][s] += sum(x[s] for x in new[:parts])
        start = [x / sum(starts) for x in starts]
        step = [[x / sum(row) for x in row] for row in steps]
        total = [sum(x[s] for x in new) for s in states]
        emit = [[x[s] / total[s] for s in states] for x in new]
    inside = {w: math.log10((counts[w] + 1) / weight[kind[w]]) for w in kind}
    return {
        i: forward(words)[1] / math.log(10) + sum(inside[w] for w in words) for i, words in texts
    }, rounds
