"""Small tables with every awkward case, and brute-force versions of the operators."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, component string"


def words(t):
    return WORD.findall(t or "")


def rows():
    """Nulls, empty, blank and one-word texts, other scripts, copies, near copies, shared passages, a long text."""
    base = [f"w{i % 97}x{i * i % 89}" for i in range(400)]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [
        " ".join(base[:120]), " ".join(base[:120]), " ".join([*base[:119], "other"]), " ".join(base[40:200]) + "\n" + passage,
        "start " + passage + "\nend of it", passage + " " + passage, None, "", " \t\n", "one", "ONE", "two words", "Two  words",
        "no-break space here is one word", "日本語 の テキスト です", "\x1c\x1d odd \x85 white space", "1234 !!! ???", "a\nb\nc\nd\na\nb\nc\nx",
        "y\na\nb\nc\nz", "<|endoftext|> isn't <s> special </s>", "▁ marks ▁▁ and  double  blanks ", "é é ﬁ 😀", " ".join(base * 30),
        " ".join(reversed(base[:120])), "The quick brown fox jumps over the lazy dog " * 3,
    ]
    out = []
    for k, t in enumerate(texts):
        out.append((k * 3 + 1, t, [None, "en", "de"][k % 3], None if k % 5 == 0 else f"s{k % 4}", k, "clash", "clash"))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward(spark):
    """Also repeated rows and rows without an id."""
    some = rows()
    return spark.createDataFrame([*some, some[0], some[3], (None, "text without id", None, None, None, None, None), (None,) * 7], SCHEMA)


def exact(table):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in table}
    groups = collections.defaultdict(list)
    for i, t in table:
        groups[norm[i]].append((-len(t or ""), i))
    best = {k: min(v)[1] for k, v in groups.items()}
    return {i: (best[norm[i]], len(groups[norm[i]]), best[norm[i]] == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in table}


def lines(table, run, least):
    seen, out = set(), {}
    for i, t in sorted(table):
        own = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(own)):
            size = next((s for s in range(1, run) if k + s <= len(own) and sum(len(words(x)) for x in own[k : k + s]) >= least), run)
            key = tuple(own[k : k + size])
            if len(key) < size:
                continue
            if key in seen:
                gone.update(range(k, k + size))
            seen.add(key)
        kept = None if t is None else "\n".join(x for k, x in enumerate(own) if k not in gone)
        out[i] = (kept, len(own), len(gone))
    return out


def links(table, n=5, percent=80):
    sets = {}
    for i, t in table:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root, count = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                count[i] += 1
                count[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), count[i]) for i in ids}


def windows(table, size=20):
    seen, out = set(), {}
    for i, t in sorted(table):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def unigrams(table, held_out):
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in table}
    count = collections.Counter(x for i, own in tokens.items() if not held_out(i) for x in own)
    n, v = sum(count.values()), len(count)
    return n, {
        i: (len(own), sum(count[x] > 0 for x in own), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own))
        for i, own in tokens.items()
    }


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def tree_scores(training, asked, least_context=24, least_next=6, divergence=0.02, min_depth=3, least_gain=0.1):
    """A probabilistic suffix tree in plain dictionaries, contexts as tuples of words; log10 scores of the asked texts, and
    the lengths of the retained contexts."""
    cut = lambda t: [*words((t or "").translate(LOWER)), None]
    texts = [cut(t) for t in training]
    count = collections.Counter(x for own in texts for x in own)
    n, v = sum(count.values()), len(count)
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    unknown = discount * v / n
    root = lambda x: (count[x] - discount) / n if x in count else unknown
    rest, mass, settled = {}, {}, {(): False}

    def p(x, context):
        """By the longest retained suffix of a context."""
        if not context:
            return root(x)
        below = p(x, context[1:])
        return mass.get((context, x), 0.0) + rest[context] * below if context in rest else below

    size = {(x,): c for x, c in count.items()}
    length = 0
    while True:
        length += 1
        following = collections.defaultdict(collections.Counter)
        for own in texts:
            for k in range(length, len(own)):
                following[tuple(own[k - length : k])][own[k]] += 1
        gained, retained, longer = 0.0, {}, {}
        for context, after in following.items():
            if size.get(context, 0) < least_context or settled.get(context[1:], True):
                continue
            own = {x: c for x, c in after.items() if c >= least_next}
            if not own:
                continue
            c, seen = size[context], sum(own.values())
            settled[context] = len(own) == 1 and seen == c
            q = {x: p(x, context[1:]) for x in own}
            d = sum(k / c * math.log(k / c / q[x]) for x, k in own.items())
            if seen < c:
                d += (1 - seen / c) * math.log((1 - seen / c) / (1 - sum(q.values())))
            if d >= divergence and 2 * c * d >= len(own) + 4 * math.sqrt(2 * len(own) + 1):
                gained += c * d
                retained[context] = (1 - (seen - 0.5 * len(own)) / c, {x: (k - 0.5) / c for x, k in own.items()})
            longer |= {(*context, x): k for x, k in own.items()}
        for context, (left, masses) in retained.items():
            rest[context] = left
            mass |= {(context, x): m for x, m in masses.items()}
        size = longer
        if length >= min_depth and gained <= least_gain * n:
            break
    scores = {}
    for i, t in asked:
        own = cut(t)
        scores[i] = sum(math.log10(p(x, tuple(own[max(0, k - length) : k]))) for k, x in enumerate(own))
    return scores, {len(c) for c in rest}
