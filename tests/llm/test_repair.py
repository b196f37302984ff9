"""Conversation repair against an exhaustive search and a plain programme over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from tagweave.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, at int, digest string, word string, part string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        chars = VISIBLE.findall(text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, result) by a table over what matters of the result so far: empty, or its last initial."""
    table = {"": (0, "", [])}

    def put(new, key, got):
        if key not in new or got[:2] < new[key][:2]:
            new[key] = got

    def inserted(table):
        for _ in range(2):
            new = dict(table)
            for q, (c, a, out) in table.items():
                r = {"": "user", "s": "user", "u": "assistant", "a": "user"}[q]
                put(new, r[0], (c + 5, a + "I", out + [f"{r}:"]))
            table = new
        return table

    ok = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    for (role, text), f in zip(rows, fault):
        new = {}
        for q, (c, a, out) in inserted(table).items():
            put(new, q, (c + 2, a + "D", out))
            if f in ("blank", "duplicate"):
                continue
            more = 5 if f == "truncated" else 0
            if (q, role[:1]) in ok and role:
                put(new, role[0], (c + more, a + "K", out + [f"{role}:{text}"]))
            for to in ("user", "assistant"):
                if (q, to[0]) in ok:
                    put(new, to[0], (c + 1 + more, a + "R", out + [f"{to}:{text}"]))
        table = new
    done = [v for q, v in inserted(table).items() if q in ("", "a")]
    return min(done, key=lambda v: v[:2])


def report(rows):
    """conv_id -> expected columns; rows with equal turns must be equal."""
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0,
                                               hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        pairs = [(r[2], r[3]) for r in mine]
        f = faults(pairs)
        turns = {r[1] for r in mine if r[1] is not None}
        roles = [role[:1] for role, _ in pairs]
        cost, audit, result = cheapest(pairs, f)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                     hashlib.sha256("\n".join(result).encode()).hexdigest())
    return out


def conversations(seed=3):
    rng = random.Random(seed)
    texts = ["Well done.", "Why?", "no end", "", "  \n", "So it is! ", None, "ends\t.\n", "été 東.", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "sys", "agent"]
    rows = []
    for conv in range(150):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 8, 20])):
            rows.append((conv, None if rng.random() < .03 else turn * rng.choice([1, 1, 1, 2]) if rng.random() < .1 else turn,
                         rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < .5 else rng.choice(["Word ", ""]) + f"{rng.random()}." if rng.random() < .8 else None))
    for turn in range(700):                                     # one long conversation, with null id and odd roles
        rows.append((None, turn, rng.choice(roles), f"{rng.randrange(500)}" + rng.choice(".!x")))
    rows += [(500, t, "tool", f"t{t}.") for t in range(600)]     # whose turn it is stays open to the end
    rows += [(501, t, "user", "the same.") for t in range(300)] + [(502, 1, "user", "x" * 200_000 + ".")] * 3
    rows += [(503, None, None, None)] * 5
    return rows


def keyed(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
            for r in df.collect()}


def test_report(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "d", "w", "p") for r in rows], SCHEMA).repartition(7)
    got, want = keyed(R.repair_report(df, R.damage(df))), report(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(df, R.damage(df)).count() == 0


def test_exhaustive():
    """The stack and the fold, on all short words, against an unbounded search over edit strings."""
    ends = {"s", "u", "a", "o", "S", "U", "A", "O", "x"}

    def brute(word):
        best = None

        def go(i, result, cost, audit):
            nonlocal best
            if best is not None and cost > best[0]:
                return
            if i == len(word) and re.fullmatch("(s?(ua)+)?", result):
                best = min(best or (10 ** 9, ""), (cost, audit))
            if len(result) > len(word) + 3 or not re.fullmatch("s?(ua)*u?", result):
                return
            if audit.count("I") < 4:
                for r in "ua":
                    go(i, result + r, cost + 5, audit + "I")
            if i < len(word):
                go(i + 1, result, cost + 2, audit + "D")
                if word[i] != "x":
                    more = 5 if word[i].isupper() else 0
                    if word[i].lower() != "o":
                        go(i + 1, result + word[i].lower(), cost + more, audit + "K")
                    for r in "ua":
                        go(i + 1, result + r, cost + 1 + more, audit + "R")
        go(0, "", 0, "")
        return best

    words = sorted(("".join(w) for n in range(1, 4) for w in itertools.product(ends, repeat=n)), key=lambda w: w[::-1])
    rng = random.Random(1)
    stack = R.SuffixStack()
    for w in words:
        t = R.parsed(R.flat(stack.transfer(w)))
        if len(w) == 3 and rng.random() < .8:
            continue
        fold = R.Fold()
        list(fold.block(t, w, b"0" * 16 * len(w)))
        list(fold.close())
        assert (fold.cost, "".join(fold.audit)) == brute(w), w
    assert stack.made <= 9 + 81 + 729          # a node per suffix, not per letter


def test_blocks_equal_one_block():
    """Any cut into blocks gives the same plan and the same rows."""
    rng = random.Random(2)
    for _ in range(300):
        letters = rng.choice(["suaoSUAOx", "o", "ox", "u", "ua", "uaUAx"])
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))
        keys = [b"%016d" % i for i in range(len(word))]

        def run(cuts):
            fold, out = R.Fold(), []
            for lo, hi in zip(cuts, cuts[1:]):
                part = word[lo:hi]
                t = R.parsed(R.flat(R.SuffixStack().transfer(part)))
                out += fold.block(t, part, b"".join(k for k, c in zip(keys[lo:hi], part) if c != "x"))
            out += fold.close()
            return fold.cost, "".join(fold.audit), out

        whole = run([0, len(word)])
        assert run(sorted({0, len(word), *(rng.randrange(len(word)) for _ in range(30))})) == whole
        assert run(list(range(len(word) + 1))) == whole
