import random
import re

from equiflow.llm import decontamination as D

DOCS = "doc_id long, text string, item_id string, coverage string"
ITEMS = "item_id long, text string, doc_id string"
QUESTION = "A train leaves the old station at 60 km per hour and Alice waits 3 hours before Bob follows in a car at 90 km per hour."


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "a", None) for x in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*x, None) for x in items], ITEMS)
    return {(r.doc_id, r.item_id): r for r in D.contaminated_pairs(d, b).collect()}


def test_verbatim_recased_and_reparameterised(spark):
    other = QUESTION.replace("Alice", "Zoe").replace("Bob", "Carl").replace("60", "45").replace("90", "1,200").replace("3 hours", "7 hours")
    r = random.Random(1)
    noise = " ".join(f"w{r.randrange(999)}" for _ in range(20_000))
    docs = [(1, f"{noise} {QUESTION} {noise}"), (2, QUESTION.upper()), (3, "Text before. " + other + " Text after."), (4, noise), (5, "## " + QUESTION.replace(" ", "**  \n")),
            (6, " ".join(QUESTION.split()[:14])), (7, " ".join(QUESTION.split()[:8]) + " x " + noise)]
    got = run(spark, docs, [(10, QUESTION), (11, QUESTION), (12, "short one"), (13, None)])
    assert set(got) == {(d, i) for d in (1, 2, 3, 5, 6) for i in (10, 11)}
    assert got[3, 10].reparameterised and not got[1, 10].reparameterised and not got[2, 10].reparameterised
    assert got[1, 10].coverage == 1.0 and got[3, 10].coverage == 1.0


def test_inconsistent_slots_do_not_count(spark):
    item = "When did Alice give the red book to Bob and why did Alice then ask Bob for the blue one"
    same = item.replace("Alice", "Xenia").replace("Bob", "Yann")
    mixed = "When did Xenia give the red book to Yann and why did Zoltan then ask Xenia for the blue one"
    merged = item.replace("Alice", "Xenia").replace("Bob", "Xenia")
    got = run(spark, [(1, "So. " + same), (2, "So. " + mixed), (3, "So. " + merged)], [(5, item)])
    assert got[1, 5].coverage == 1.0 and got[1, 5].reparameterised
    assert all(got[k].coverage < 1 for k in got if k[0] != 1)


def test_equals_brute_force_on_verbatim_copies(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"v{r.randrange(300)}" for _ in range(r.randrange(4, 40)))) for i in range(60)]
    docs = []
    for i in range(300):
        words = [f"v{r.randrange(300)}" for _ in range(r.randrange(0, 200))]
        if i % 3 == 0:
            k = r.randrange(len(words) + 1)
            words[k:k] = r.choice(items)[1].split()
        docs.append((i, " ".join(words)))
    got = run(spark, docs, items)
    padded = {i: f" {t} " for i, t in docs}
    whole = {(d, i) for d, t in padded.items() for i, x in items if f" {x} " in t}
    assert {k for k, v in got.items() if v.coverage == 1.0} == whole
    assert all(0.5 <= v.coverage <= 1 for v in got.values())


def test_dealt_windows_give_the_same(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + QUESTION if i % 2 else "nothing here", "a", None) for i in range(20)], DOCS)
    items = spark.createDataFrame([(i, QUESTION + f" number{i} tail", None) for i in range(8)], ITEMS)
    whole = {tuple(r) for r in D.contaminated_pairs(docs, items).collect()}
    dealt = {tuple(r) for r in D.contaminated_pairs(docs, items, broadcast_windows=0).collect()}
    assert whole == dealt and len(whole) == 80
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, items, broadcast_windows=0).collect()) == list(range(0, 20, 2))


def test_short_sentences_with_names_at_their_start(spark):
    item = "Alice has 3 apples. Bob has 4 apples. Carol has 5 pears. Dan eats 2 pears. How many are left?"
    other = "Zoe has 8 apples. Yann has 9 apples. Xenia has 6 pears. Wim eats 1 pears. How many are left?"
    got = run(spark, [(1, "Read this. " + other + " Thanks."), (2, "Zoe has a dog. Yann has a cat. Xenia has two pears. Wim eats cake. How many are there?"), (3, other.replace("Wim", "Zoe"))], [(5, item)])
    assert got[1, 5].coverage == 1.0 and got[1, 5].reparameterised
    assert (2, 5) not in got and (3, 5) not in got or got[3, 5].coverage < 1


def test_slots_of_more_words_and_shifted_diagonals(spark):
    item = "a courier leaves Paris at noon with 12 sealed letters and rides to Rome where every letter is read aloud by the old mayor"
    longer = item.replace("Paris", "New York City").replace("Rome", "San Marino").replace("12", "30")
    shifted = item.replace("letters and", "letters that day and")
    got = run(spark, [(1, longer), (2, "then " + shifted)], [(5, item)])
    assert got[1, 5].coverage == 1.0 and got[1, 5].reparameterised
    assert got[2, 5].covered_tokens == 24


def _slow_tokens(text, openers):
    """(plain words, type or None) of the tokens of a text, names that touch as one; from the definitions, word by word."""
    out, start, apart, number = [], True, True, False
    for raw in text.split():
        word = raw if raw.lower() in D.UNITS else re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        if word:
            low, kind = word.lower(), None
            if re.fullmatch(r"[+-]?\d[\d.,/:]*", low):
                kind = "number"
            elif low in D.UNITS:
                kind = "unit" if number else None
            elif word[0].isupper() and not word.isupper() and (openers or not start):
                kind = "name"
            if kind == "name" and out and out[-1][1] == "name" and not apart:
                out[-1] = (out[-1][0] + (low,), "name")
            else:
                out.append(((low,), kind))
            number = kind == "number"
            apart = not raw[-1].isalnum()
        else:
            apart = True
        start = bool(re.search(r"[.!?:][\"')\]]*$", raw))
    return out


def _slow_hits(doc, item):
    """Every pair of windows that meet, by comparing them all."""
    hits = []
    plain = [_slow_tokens(t, False) for t in (doc, item)]
    flat = [[(w,) for ws, _ in t for w in ws] for t in plain]
    raw = [[((w,), None) for (w,) in t] for t in flat]
    levels = [(raw[0], raw[1], False)] + [(_slow_tokens(doc, a), _slow_tokens(item, b), True) for a in (False, True) for b in (False, True)]
    for d, i, template in levels:
        n = min(D.WIDTH, len(i))
        if n < D.MIN_TOKENS:
            continue
        at = [[sum(len(ws) for ws, _ in t[:k]) for k in range(len(t) + 1)] for t in (d, i)]
        seen = [[(t or ws) for ws, t in s] for s in (d, i)]
        for p in range(len(d) - n + 1):
            for q in range(len(i) - n + 1):
                if seen[0][p : p + n] == seen[1][q : q + n] and (not template or 2 * sum(t is None for _, t in i[q : q + n]) >= n):
                    slots = [(t, a, b) for (a, t), (b, _) in zip(i[q : q + n], d[p : p + n]) if t]
                    hits.append((at[0][p], at[1][q], at[1][q + n] - at[1][q], template, slots))
    return hits


def _slow_diagonal(hits):
    """Best covered count on one diagonal, consistent slots only, verbatim windows first."""
    best = 0
    for d in {p - q for p, q, *_ in hits}:
        there, back, covered = {}, {}, set()
        for p, q, r, _, slots in sorted((h for h in hits if h[0] - h[1] == d), key=lambda h: (h[3], h[0], h[1])):
            a, b = dict(there), dict(back)
            if all(a.setdefault((t, x), y) == y and (t == "number" or b.setdefault((t, y), x) == x) for t, x, y in slots):
                there, back = a, b
                covered |= set(range(q, q + r))
        best = max(best, len(covered))
    return best


def test_templates_against_a_slow_reference(spark):
    r = random.Random(7)
    names, words = ["Ada", "Ben", "Cleo", "New York", "Oslo", "Eva Maria"], "has sold bought apples pears from with and then gives to the old young where lives who".split()

    def sentence():
        out = [r.choice(names) if r.random() < 0.4 else r.choice(words).capitalize()]
        for _ in range(r.randrange(4, 9)):
            out.append(str(r.randrange(2, 40)) + r.choice(["", " kg"]) if r.random() < 0.15 else r.choice(names) if r.random() < 0.15 else r.choice(words))
        return " ".join(out) + "."

    def asked_again(text):
        swap = dict(zip(names, r.sample(["Finn", "Gil", "Hal", "Ida Lou", "Jon", "Kim"], len(names))))
        for a, b in swap.items():
            text = text.replace(a, b)
        return re.sub(r"\d+", lambda m: str(int(m[0]) + 41), text)

    items = [(i, " ".join(sentence() for _ in range(r.randrange(1, 4)))) for i in range(12)]
    docs = [(i, " ".join([sentence(), items[i % 12][1] if i % 3 else asked_again(items[i % 12][1]), sentence()][r.randrange(2) :])) for i in range(48)]
    got = run(spark, docs, items)
    for d, doc in docs:
        for i, item in items:
            hits, total = _slow_hits(doc, item), sum(len(ws) for ws, _ in _slow_tokens(item, False))
            least = _slow_diagonal(hits)
            union = len({k for _, q, n, *_ in hits for k in range(q, q + n)})
            if least >= D.MIN_COVERAGE * total:
                assert got[d, i].covered_tokens >= least and got[d, i].item_tokens == total
            if (d, i) in got:
                assert least <= got[d, i].covered_tokens <= union
    assert {(d, d % 12) for d, _ in docs if d % 3} <= set(got)
    assert sum(got[d, d % 12].reparameterised for d, _ in docs if d % 3 == 0 and (d, d % 12) in got) >= 8  # the others are names for the most part


def test_a_hundred_copies_of_one_row_are_reported_each(spark):
    d = spark.createDataFrame([(1, QUESTION, "x", None)] * 100, DOCS).repartition(5)
    assert D.contaminated_pairs(d, spark.createDataFrame([(9, QUESTION, None)], ITEMS)).count() == 100


def test_edge_cases(spark):
    assert run(spark, [(1, None), (2, ""), (None, QUESTION), (None, QUESTION)], [(1, QUESTION)]).keys() == {(None, 1)}
    assert not run(spark, [(1, QUESTION)], [])
    d = spark.createDataFrame([(1, QUESTION, "x", "y"), (2, None, "x", "y"), (3, "clean text", None, None)], DOCS)
    b = spark.createDataFrame([(1, QUESTION, "z")], ITEMS)
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert D.contaminated_pairs(d.limit(0), b).count() == 0
