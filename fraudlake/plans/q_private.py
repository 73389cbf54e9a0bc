"""Registered queries: private federated rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.functions.hashrand import uniform_sql
from fraudlake.operators import private_rounds as PR
from fraudlake.plans.q_privacy import CLIP, DELTA, SEED, SIGMA, ledger_sql
from fraudlake.plans.q_rounds import DIM, features, x_sql
from fraudlake.plans.q_split import SPLIT_SQL, TX
from fraudlake.plans.registry import register

ROUNDS, LR, Q = 3, 4.0, 0.1
# one bank's budget ends after the first round, one's after the second
BUDGETS, GLOBAL_BUDGET = {"bank_1": 1.0, "bank_2": 1.9}, 50.0


def _rounds_sql() -> str:
    """The rounds written out; a bank takes part while the ledger of the rounds before is
    below its budget."""
    w = [f"w{i}" for i in range(DIM)] + ["b"]
    z = " + ".join(f"m.w{i} * f.x[{i + 1}]" for i in range(DIM)) + " + m.b"
    budget = " ".join(f"when '{c}' then {v!r}" for c, v in BUDGETS.items())
    ctes = [
        f"f as (select bank_id, TransactionID as id, cast(isFraud as double) as y, {x_sql()} as x from splitted "
        "where split = 'train' and bank_id is not null)",
        f"sizes as (select bank_id, count(*) as n, case bank_id {budget} else {GLOBAL_BUDGET!r} end as budget "
        "from f group by bank_id)",
        f"round_metrics as (select 'any' as client_id, unnest(range(1, {ROUNDS + 1})) as round, 1 as num_examples)",
        ledger_sql(steps=f"steps as (select client_id, 'run' as run_id, round, 1 as steps, {Q} as q, {SIGMA} as sigma "
                         "from round_metrics)").strip(),
        "m0 as (select " + ", ".join(f"cast(0 as double) as {v}" for v in w) + ")"]
    out = []
    for k in range(1, ROUNDS + 1):
        draw = uniform_sql(["id", str(k), "1", "'row'"], SEED)
        ctes.append(f"a{k} as (select bank_id, n from sizes where budget > coalesce((select epsilon_spent from ledger "
                    f"where round = {k - 1}), 0.0))")
        ctes.append(f"e{k} as (select f.bank_id, x, 1 / (1 + exp(-({z}))) - y as e from f join a{k} using (bank_id), "
                    f"m{k - 1} m where {draw} < {Q})")
        ctes.append(f"n{k} as (select *, abs(e) * sqrt(1 + list_sum(list_transform(x, lambda v: v * v))) as norm from e{k})")
        ctes.append(f"c{k} as (select *, e * case when norm > {CLIP} then {CLIP} / norm else 1.0 end as s from n{k})")
        sums = ", ".join(f"sum(s * x[{i + 1}]) as g{i}" for i in range(DIM))
        ctes.append(f"g{k} as (select bank_id, count(*) as sampled, count(*) filter (where norm > {CLIP}) as clipped, "
                    f"{sums}, sum(s) as g{DIM} from c{k} group by bank_id)")
        new = []
        for i, v in enumerate(w):
            u1, u2 = (uniform_sql(["a.bank_id", str(k), "1", str(i)], s) for s in (SEED, f"{SEED}b"))
            noise = f"{SIGMA * CLIP!r} * sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {u2})"
            new.append(f"m.{v} - {LR} * (coalesce(g{i}, 0.0) + {noise}) / ({Q} * a.n) as {v}")
        ctes.append(f"l{k} as (select a.bank_id, a.n, coalesce(sampled, 0) as sampled, coalesce(clipped, 0) as clipped, "
                    f"{', '.join(new)} from a{k} a left join g{k} g on a.bank_id = g.bank_id, m{k - 1} m)")
        ctes.append(f"m{k} as (select " + ", ".join(f"sum(n * {v}) / sum(n) as {v}" for v in w) + f" from l{k})")
        eps = f"(select epsilon_spent from ledger where round = {k}) as epsilon_spent"
        out.append(f"select {k} as round, bank_id as client_id, n, sampled, clipped, w0, b, {eps} from l{k}")
        out.append(f"select {k}, 'global', (select cast(sum(n) as bigint) from l{k}), "
                   f"(select cast(sum(sampled) as bigint) from l{k}), (select cast(sum(clipped) as bigint) from l{k}), "
                   f"w0, b, {eps} from m{k}")
    return SPLIT_SQL + ",\n" + ",\n".join(ctes) + "\n" + "\nunion all ".join(out)


@register("private_rounds", "H9", views=TX, rounded={"w0": 8, "b": 8, "epsilon_spent": 6}, sql=_rounds_sql())
def q_private_rounds(spark, sf_dir):
    """H9 + P1/P2/P4/P6: three private rounds; banks stop when their budget is spent."""
    out = PR.private_rounds(spark, features(spark, sf_dir), DIM, ROUNDS, 1, LR, Q, CLIP, SIGMA, DELTA, BUDGETS,
                            GLOBAL_BUDGET, SEED)
    return out.select("round", "client_id", "n", "sampled", "clipped", F.col("w")[0].alias("w0"), "b", "epsilon_spent")
