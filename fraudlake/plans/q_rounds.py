"""Registered queries: federated rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import rounds as R
from fraudlake.plans.q_split import SPLIT_SQL, TX, splitted
from fraudlake.plans.registry import register
from fraudlake.sources import fixtures as fx

RM = ("round_metrics",)
UP = ("updates",)

# fixed feature set for the linear model queries: (name, expression valid in Spark and DuckDB)
FEATURES = [
    ("amount", "TransactionAmt / 100000.0"),
    ("score", "score"),
    ("card2", "coalesce(card2, 350.0) / 600.0"),
    ("addr2", "coalesce(addr2, 3.0) / 6.0"),
    ("dt", "cast(TransactionDT as double) / 200000000.0"),
    ("card1", "cast(card1 % 100 as double) / 100.0"),
]
FEATURE_NAMES = [n for n, _ in FEATURES]
DIM = len(FEATURES)
SCORE_W = [2.0, 6.0, -0.5, 0.3, -0.2, 0.1]
SCORE_B = -4.0


def features(spark, sf_dir, split: str | None = "train"):
    s = splitted(spark, sf_dir)
    if split:
        s = s.where(F.col("split") == split)
    return s.select("TransactionID", "bank_id", "split", F.col("isFraud").alias("label"),
                    F.array(*[F.expr(e).cast("double") for _, e in FEATURES]).alias("x"))


def x_sql() -> str:
    return "[" + ", ".join(f"cast({e} as double)" for _, e in FEATURES) + "]"


def logit_sql(w, b) -> str:
    acc = "0.0"
    for i, (_, e) in enumerate(FEATURES):
        acc = f"({acc} + {w[i]!r} * cast({e} as double))"
    return f"({acc} + {b!r})"


MISSING = "client_id = 'bank_2' and round % 7 = 0"


def _rm_missing(spark, sf_dir):
    rm = fx.round_metrics(spark, sf_dir)
    return rm.withColumn("loss", F.when(~F.expr(MISSING), F.col("loss")))


AGG_SQL = f"""
rm as (select client_id, round, num_examples, auprc, auroc,
   case when {MISSING} then null else loss end as loss, epsilon from round_metrics),
long as (select client_id, round, num_examples, key, value from (
     select client_id, round, num_examples, 'auprc' as key, auprc as value from rm
     union all select client_id, round, num_examples, 'auroc', auroc from rm
     union all select client_id, round, num_examples, 'loss', loss from rm
     union all select client_id, round, num_examples, 'epsilon', epsilon from rm)
   where value is not null),
cl as (select round, client_id, max(num_examples) as n from long group by round, client_id),
tot as (select round, sum(n) as total, min(client_id) as first_client from cl group by round),
sums as (select round, key, sum(num_examples * value) as nv, max(value) as mx,
   list(distinct client_id) as clients from long group by round, key)"""


@register("agg_fit_metrics", "H1", views=RM, rounded={"value": 9}, sql=AGG_SQL + """
select s.round, s.key, case when s.key in ('epsilon', 'delta') then s.mx
  else s.nv / t.total end as value
from sums s join tot t on s.round = t.round where list_contains(s.clients, t.first_client)""")
def q_agg_fit_metrics(spark, sf_dir):
    """H1: example-weighted fit metrics per round, epsilon by max, missing keys count 0."""
    long = R.long_metrics(_rm_missing(spark, sf_dir), ["client_id", "round", "num_examples"],
                          ["auprc", "auroc", "loss", "epsilon"])
    return R.aggregate_metrics(long)


@register("agg_eval_metrics", "H2", views=RM, rounded={"value": 9}, sql=AGG_SQL + """
select s.round, s.key, s.nv / t.total as value
from sums s join tot t on s.round = t.round
where list_contains(s.clients, t.first_client) and s.key <> 'epsilon'""")
def q_agg_eval_metrics(spark, sf_dir):
    """H2: example-weighted evaluation metrics per round (no max rule)."""
    long = R.long_metrics(_rm_missing(spark, sf_dir), ["client_id", "round", "num_examples"],
                          ["auprc", "auroc", "loss"])
    return R.aggregate_metrics(long, max_keys=())


EXPLODED_SQL = """
ux as (select round, client_id, tensor, num_examples, unnest(w) as v,
   unnest(range(0, len(w))) as pos from updates)"""


@register("fedavg", "H3", views=UP, rounded={"value": 9}, sql=EXPLODED_SQL + """
select round, tensor, cast(pos as integer) as pos,
  sum(num_examples * v) / sum(num_examples) as value
from ux group by round, tensor, pos""")
def q_fedavg(spark, sf_dir):
    """H3: example-weighted element-wise mean of client weights per round."""
    return R.fedavg(fx.updates(spark, sf_dir))


@register("min_clients", "H4", views=UP, sql="""
select round, count(distinct client_id) as n_clients,
  case when count(distinct client_id) >= 3 then 'completed' else 'skipped' end as status
from updates group by round""")
def q_min_clients(spark, sf_dir):
    """H4: rounds with fewer than 3 clients are skipped (the last round has 2)."""
    return R.min_clients(fx.updates(spark, sf_dir), 3)


TAMPER = [
    ("round % 17 = 3 and client_id = 'bank_1'", "scale"),
    ("round % 19 = 4 and client_id = 'bank_2'", "short"),
    ("round % 23 = 5 and client_id = 'bank_3'", "nan"),
]


def tampered(spark, sf_dir):
    u = fx.updates(spark, sf_dir)
    w = (F.when(F.expr(TAMPER[0][0]), F.transform("w", lambda x: x * 1000.0))
         .when(F.expr(TAMPER[1][0]), F.slice("w", 1, 63))
         .when(F.expr(TAMPER[2][0]), F.concat(F.array(F.lit(float("nan"))), F.slice("w", 2, 63)))
         .otherwise(F.col("w")))
    return u.withColumn("w", w)


TAMPER_SQL = f"""
tw as (select round, client_id, tensor, num_examples, case
     when {TAMPER[0][0]} then list_transform(w, lambda x: x * 1000.0)
     when {TAMPER[1][0]} then list_slice(w, 1, 63)
     when {TAMPER[2][0]} then list_concat(['nan'::double], list_slice(w, 2, 64))
     else w end as w from updates)"""


@register("weight_checks", "H5", views=UP, sql=TAMPER_SQL + """,
lens as (select round, tensor, len(w) as l, count(*) as c from tw group by round, tensor, len(w)),
modal as (select round, tensor, first(l order by c desc, l asc) as modal from lens
   group by round, tensor),
chk as (select t.*, case
     when len(list_filter(t.w, lambda x: isnan(x) or isinf(x))) > 0 then 'nan_or_inf'
     when len(t.w) <> m.modal then 'wrong_shape'
     when list_max(list_transform(t.w, lambda x: abs(x))) >= 100 then 'too_large' end as reason
   from tw t join modal m on t.round = m.round and t.tensor = m.tensor)
select round, client_id, tensor, reason is null as valid, reason from chk""")
def q_weight_checks(spark, sf_dir):
    """H5: updates with NaN/Inf, wrong length or |w| >= 100 are rejected."""
    return R.weight_checks(tampered(spark, sf_dir)).select(
        "round", "client_id", "tensor", "valid", "reason")


@register("norm_outliers", "H6", views=UP, rounded={"norm": 9}, sql="""
nine as (select cast(floor(round / 3) as bigint) as round,
   client_id || '_' || cast(round % 3 as varchar) as client_id, tensor,
   list_transform(w, lambda x: x * case when (3 * round + ascii(right(client_id, 1))) % 14 = 0
     then 40.0 else 1.0 end) as w from updates),
n as (select round, client_id, tensor, sqrt(list_sum(list_transform(w, lambda x: x * x))) as norm
   from nine),
s as (select round, tensor, avg(norm) as mu, stddev_pop(norm) as sd from n group by round, tensor)
select n.round, n.client_id, n.tensor, n.norm, abs(n.norm - s.mu) > 2 * s.sd as outlier
from n join s on n.round = s.round and n.tensor = s.tensor""")
def q_norm_outliers(spark, sf_dir):
    """H6: update norms and the 2-sd outlier rule per round (nine clients, some with a
    far too long update)."""
    nine = fx.updates(spark, sf_dir).selectExpr(
        "cast(floor(round / 3) as bigint) as round",
        "concat(client_id, '_', cast(round % 3 as string)) as client_id", "tensor",
        "transform(w, x -> x * case when (3 * round + ascii(right(client_id, 1))) % 14 = 0 "
        "then 40.0D else 1.0D end) as w")
    return R.norm_outliers(nine).select(
        "round", "client_id", "tensor", "norm", "outlier")


@register("weight_change", "H7", views=UP, rounded={"weight_change": 9}, sql=EXPLODED_SQL + """
,
kept as (select * from ux where (3 * round + length(client_id) + ascii(right(client_id, 1))) % 5 <> 0),
turns as (select client_id, round, lag(round) over (partition by client_id order by round) as before
   from (select distinct client_id, round from kept)),
a as (select k.*, t.before from kept k join turns t on k.client_id = t.client_id and k.round = t.round
   where t.before is not null),
b as (select k.client_id, k.tensor, k.pos, k.v, t.round as later from kept k
   join turns t on k.client_id = t.client_id and k.round = t.before),
pairs as (select coalesce(a.round, b.later) as round, coalesce(a.client_id, b.client_id) as client_id,
   coalesce(a.v, 0) - coalesce(b.v, 0) as d
   from a full join b on a.client_id = b.client_id and a.tensor = b.tensor and a.pos = b.pos
    and a.round = b.later)
select round, client_id, sqrt(sum(d * d)) as weight_change from pairs group by round, client_id""")
def q_weight_change(spark, sf_dir):
    """H7: L2 norm of the change since the client's previous round (clients miss some rounds)."""
    return R.weight_change(fx.updates(spark, sf_dir).where(
        "(3 * round + length(client_id) + ascii(right(client_id, 1))) % 5 <> 0"))


@register("sample_counts", "H8", views=UP, sql="""
select client_id, round, cast(sum(num_examples) as bigint) as samples from updates
group by client_id, round""")
def q_sample_counts(spark, sf_dir):
    """H8: training examples per client per round."""
    return R.sample_counts(fx.updates(spark, sf_dir))


def _fed_long(df):
    w = df.select("round", "client_id", "n", "train_loss",
                  F.posexplode("w").alias("pos", "value"))
    b = df.select("round", "client_id", "n", "train_loss", F.lit(-1).alias("pos"),
                  F.col("b").alias("value"))
    return w.unionByName(b).withColumn("pos", F.col("pos").cast("int"))


def _fed_sql() -> str:
    g = ", ".join(f"sum((0.5 - y) * x[{i + 1}]) as g{i}" for i in range(DIM))
    loc = " union all ".join(
        f"select bank_id, n, {i} as pos, -0.5 * (g{i} / n) as value from g" for i in range(DIM))
    return SPLIT_SQL + f""",
f as (select bank_id, cast(isFraud as double) as y, {x_sql()} as x from splitted
   where split = 'train'),
g as (select bank_id, count(*) as n, sum(0.5 - y) as gb, {g} from f group by bank_id),
loc as ({loc} union all select bank_id, n, -1, -0.5 * (gb / n) from g),
glb as (select 'global' as bank_id, cast(sum(n) as bigint) as n, pos, sum(n * value) / sum(n) as value
   from loc group by pos)
select 1 as round, bank_id as client_id, n, ln(2.0) as train_loss, pos, value from loc
union all select 1, bank_id, n, ln(2.0), pos, value from glb"""


@register("fed_round_linear", "H9", views=TX, rounded={"train_loss": 9, "value": 9},
          sql=_fed_sql())
def q_fed_round_linear(spark, sf_dir):
    """H9: one federated round (one local gradient step per bank) of a logistic model."""
    out = R.federated_linear(spark, features(spark, sf_dir), DIM, rounds=1, local_steps=1,
                             lr=0.5, mu=0.0)
    return _fed_long(out)


@register("fed_rounds_train", "H9")
def q_fed_rounds_train(spark, sf_dir):
    """H9: 10 FedProx rounds (mu 0.01, 2 local steps); training loss per round and client."""
    out = R.federated_linear(spark, features(spark, sf_dir), DIM, rounds=10, local_steps=2,
                             lr=2.0, mu=0.01)
    return out.select("round", "client_id", "n", "train_loss")


POS_WEIGHT, FED_LR, FED_ROUNDS = 5.0, 2.0, 3


def _fed_rounds_sql() -> str:
    """The rounds written out: each takes the global model of the one before."""
    ctes, w = [], [f"w{i}" for i in range(DIM)] + ["b"]
    ctes.append("f as (select bank_id, split, cast(isFraud as double) as y, "
                f"{x_sql()} as x from splitted)")
    ctes.append("m0 as (select " + ", ".join(f"cast(0 as double) as {v}" for v in w) + ")")
    z = " + ".join(f"m.w{i} * f.x[{i + 1}]" for i in range(DIM)) + " + m.b"
    loss = (f"((1 - y) * z + (1 + {POS_WEIGHT - 1} * y) * (ln(1 + exp(-abs(z))) + greatest(-z, 0)))")
    out = []
    for k in range(1, FED_ROUNDS + 1):
        ctes.append(f"z{k} as (select bank_id, y, x, {z} as z from f, m{k - 1} m where split = 'train')")
        ctes.append(f"e{k} as (select *, (1 - y) / (1 + exp(-z)) - {POS_WEIGHT} * y * (1 - 1 / (1 + exp(-z))) as e "
                    f"from z{k})")
        grads = ", ".join(f"m.w{i} - {FED_LR} * sum(e * x[{i + 1}]) / count(*) as w{i}" for i in range(DIM))
        by = ", ".join(f"m.{v}" for v in w)
        ctes.append(f"l{k} as (select bank_id, count(*) as n, avg({loss}) as loss, {grads}, "
                    f"m.b - {FED_LR} * sum(e) / count(*) as b from e{k}, m{k - 1} m group by bank_id, {by})")
        ctes.append(f"m{k} as (select " + ", ".join(f"sum(n * {v}) / sum(n) as {v}" for v in w) + f" from l{k})")
        ctes.append(f"v{k} as (select bank_id, count(*) as n, avg({loss}) as val_loss from (select bank_id, y, "
                    f"{z} as z from f, m{k} m where split = 'val') group by bank_id)")
        out.append(f"select {k} as round, l.bank_id as client_id, cast(l.n as bigint) as n, loss as train_loss, "
                   f"val_loss, l.b from l{k} l left join v{k} v on l.bank_id = v.bank_id")
        out.append(f"select {k}, 'global', cast((select sum(n) from l{k}) as bigint), "
                   f"(select sum(n * loss) / sum(n) from l{k}), (select sum(n * val_loss) / sum(n) from v{k}), "
                   f"b from m{k}")
    return SPLIT_SQL + ",\n" + ",\n".join(ctes) + "\n" + "\nunion all ".join(out)


@register("fed_rounds_weighted", "H9", views=TX, rounded={"train_loss": 8, "val_loss": 8, "b": 8},
          sql=_fed_rounds_sql())
def q_fed_rounds_weighted(spark, sf_dir):
    """H9: three rounds with weighted positives, each evaluated on the validation rows."""
    s = features(spark, sf_dir, split=None)
    out = R.federated_linear(spark, s.where(F.col("split") == "train"), DIM, rounds=FED_ROUNDS, lr=FED_LR,
                             pos_weight=POS_WEIGHT, validation=s.where(F.col("split") == "val"))
    return out.select("round", "client_id", "n", "train_loss", "val_loss", "b")


@register("score_rows", "H10", views=TX, rounded={"logit": 9, "probability": 9},
          sql=f"""
z as (select TransactionID, {logit_sql(SCORE_W, SCORE_B)} as logit from transactions)
select TransactionID, logit, 1.0 / (1.0 + exp(-logit)) as probability,
  cast(1.0 / (1.0 + exp(-logit)) > 0.5 as int) as predicted_class from z""")
def q_score_rows(spark, sf_dir):
    """Sigmoid of the linear score with fixed weights; class at > 0.5
    (a pure per-row projection of the transactions)."""
    tx = fx.transactions(spark, sf_dir).select(
        "TransactionID", F.array(*[F.expr(e).cast("double") for _, e in FEATURES]).alias("x"))
    return R.score_rows(tx, SCORE_W, SCORE_B).select(
        "TransactionID", "logit", "probability", "predicted_class")


@register("best_run", "H11", views=RM, rounded={"best_auprc": 9, "auroc": 9}, sql="""
select client_id, first(round order by auprc desc, round asc) as best_epoch,
  max(auprc) as best_auprc, first(auroc order by auprc desc, round asc) as auroc
from round_metrics group by client_id""")
def q_best_run(spark, sf_dir):
    """Round with the highest AUPRC per client (earliest on ties), with its AUROC."""
    return R.best_run(fx.round_metrics(spark, sf_dir))
