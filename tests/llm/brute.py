"""Plain versions of the operators for small inputs, and rows with every awkward case."""
import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The columns of documents, and others whose names operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, at bigint, fp string, row string, key int, class string, gone int, id string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"


def edge_rows():
    texts = [(1, ""), (2, None), (3, "1234 !!! 56"), (4, "a few words here"), (5, LONG), (6, LONG), (6, LONG), (7, LONG + "\nand a tail"),
             (None, "no id at all"), (None, None), (8, "x" * 70_000), (9, "wörd " * 30_000), (10, " \n\t "), (11, "end<|endoftext|>of  text \n\n"),
             (12, "日本語のテキスト 😀 é")]
    return [(i, t, "en" if k % 3 else None, None, None if t is None else len(t), None, "fp", None, 1, "c", None, "i") for k, (i, t) in enumerate(texts)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    """[(doc_id, fingerprint, smallest id reachable)] of rows (doc_id, text)."""
    prints = [simhash(t) for _, t in rows]
    u, each = Union(), sorted(set(prints))
    for i, a in enumerate(each):
        u.find(a)
        for b in each[:i]:
            if (a ^ b).bit_count() <= 2:
                u.join(a, b)
    low = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            low[u.find(p)] = min(d, low.get(u.find(p), d))
    return [(d, f"{p:016x}", low.get(u.find(p))) for (d, _), p in zip(rows, prints)]


def plain(line):
    return [w for t in line.split() if (w := re.sub(r"^[\W_]+|[\W_]+$", "", t.lower()))]


def paragraph_clusters(rows):
    """Clusters of near-equal paragraphs: lists of (doc_id, line) of at least two."""
    where = defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if len(w := plain(line)) >= 20:
                where[" ".join(w)].append((d, i))
    sets = {k: {*zip(*(k.split()[j:] for j in range(5)))} for k in where}
    u, seen = Union(), defaultdict(list)
    for k, s in sets.items():
        for other, n in Counter(o for g in s for o in seen[g]).items():
            if n / (len(s) + len(sets[other]) - n) >= 0.8:
                u.join(k, other)
        for g in s:
            seen[g].append(k)
    out = defaultdict(list)
    for k, at in where.items():
        out[u.find(k)] += at
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


def holds(text, item):
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    return f" {words(item)} " in f" {words(text or '')} "


def tokens(texts):
    tok = Tokenizer.from_file(TOKENIZER)
    tok.no_truncation()
    tok.no_padding()
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return [(i, tok.decode(i, skip_special_tokens=False)) for i in ids]
