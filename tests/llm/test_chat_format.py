import hashlib
import random

from pyspark.sql import functions as F

from leadweave.llm import chat_format as chat

MESSAGES = "tree long, message long, parent long, role string, text string, score double"


def brute(rows, best=None):
    """All root-to-leaf paths by walking up from each leaf."""
    nodes = {}
    for t, m, p, role, text, s in rows:
        new = (role or "", text or "", p, s)
        key = lambda n: (n[0], n[1], n[2] is not None, n[2] or 0, n[3] is not None, n[3] or 0)
        nodes[t, m] = min(nodes.get((t, m), new), new, key=key)
    up = {k: (k[0], n[2]) if n[2] is not None and n[2] < k[1] and (k[0], n[2]) in nodes else None for k, n in nodes.items()}
    parents = {(k[0], n[2]) for k, n in nodes.items() if n[2] is not None and n[2] < k[1]}
    out = {}
    for leaf in nodes.keys() - parents:
        path, at = [], leaf
        while at:
            path.append(at)
            at = up[at]
        out.setdefault(leaf[0], []).append((-sum(nodes[p][3] or 0 for p in path), leaf[1], [nodes[p][:2] for p in reversed(path)]))
    return {(t, rank + 1): (leaf, turns) for t, found in out.items() for rank, (_, leaf, turns) in enumerate(sorted(found)) if not best or rank < best}


def test_trees(spark):
    rng, rows = random.Random(3), []
    for tree in (1, 2, None):
        for m in range(40):
            rows.append((tree, m, rng.randrange(m) if m and rng.random() < 0.95 else None, rng.choice(["user", "assistant", None, "<|end|>"]), rng.choice(["", None, "a\\<|turn|>b", "</s>[INST]", f"t{m}\n"]), rng.choice([None, 0.5, 2.0])))
    rows += [(1, 5, 3, "user", "again", 1.0), rows[7], (3, 1, 9, "user", "parent is later", None), (3, 9, 1, "assistant", "x", None), (4, 1, 1, "user", "own parent", None)]
    for best in (None, 2):
        got = chat.format_trees(spark.createDataFrame(rows, MESSAGES), best).collect()
        back = {(r.tree, r["rank"]): (r.leaf, chat.read_back(r.formatted, [(s.start, s.end) for s in r.loss_spans])[0]) for r in got}
        assert back == brute(rows, best)
        for r in got:
            turns, loss = chat.read_back(r.formatted, [(s.start, s.end) for s in r.loss_spans])
            assert loss == "".join(text for role, text in turns if role == "assistant") and r.n_turns == len(turns)


def test_conversation_digests(spark):
    turns = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "assistant", None), (1, 1, None, "é\n"), (2, None, "user", "x" * 50000), (2, 0, "assistant", "|>"), (2, 0, "assistant", "|>"), (None, 0, "assistant", "n")]
    got = {r.tree: r for r in chat.digests(chat.format_trees(chat.as_trees(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t[1:] for t in turns if t[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in own)
        loss = "".join(x or "" for _, r, x in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_trees(spark.createDataFrame([], MESSAGES)).count() == 0


def test_deep_chain_takes_few_joins(spark):
    chain = spark.range(500).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("message"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    jumps, _ = chat.reach_roots(chain.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent"))))
    assert len(jumps) == 9
    row = chat.format_trees(chain).first()
    assert row.n_turns == 500 and row.branch_score == 500 and [t for _, t in chat.read_back(row.formatted, [])[0]] == [str(i) for i in range(500)]
