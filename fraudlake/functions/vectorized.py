"""Array work inside Arrow-batched tasks: bootstrap draws and sampled attributions."""

import pandas as pd

from fraudlake.functions.hashrand import poisson_table


def poisson_draws(keys, label, counts, replicates, seed, tables):
    """Matrix (key, replicate) of Poisson(count) draws from the uniforms that ``hashrand.uniform``
    gives for (key, label, replicate). ``tables`` remembers the CDF of every count."""
    import hashlib

    import numpy as np

    out = np.zeros((len(keys), len(replicates)), dtype=np.int64)
    tails = [f":{label}:{r}:{seed}".encode() for r in replicates]
    md5 = hashlib.md5
    for i, (key, count) in enumerate(zip(keys, counts)):
        if count > 0:
            if count not in tables:
                tables[count] = poisson_table(float(count))
            first, cdf = tables[count]
            head = str(key).encode()
            bits = np.frombuffer(b"".join([md5(head + t).digest()[:4] for t in tails]), dtype=">u4")
            out[i] = first + np.searchsorted(cdf, (bits + 0.5) / 4294967296.0, side="left")
    return out


WALK = 512        # scores whose draws are held at a time


def bootstrap_walk(groups, above, replicates, seed):
    """Walk one score range downwards with a running sum per replicate.

    ``groups``: key, score, n_pos, n_neg per distinct score; ``above``: weights (positive,
    negative) of all higher ranges, a row per replicate, or None to add up totals only.
    Returns per replicate positive and negative weight, precision steps and pairs won.
    """
    import numpy as np

    g = groups.sort_values("score", ascending=False)
    key, n_pos, n_neg = (g[c].to_numpy() for c in ("key", "n_pos", "n_neg"))
    total, steps, pairs = np.zeros((2, len(replicates)), dtype=np.int64), np.zeros(len(replicates)), np.zeros(len(replicates))
    tables = {}
    for at in range(0, len(g), WALK):
        part = slice(at, at + WALK)
        pos = poisson_draws(key[part], 1, n_pos[part], replicates, seed, tables)
        neg = poisson_draws(key[part], 0, n_neg[part], replicates, seed, tables)
        if above is not None:
            up = np.cumsum(pos, axis=0) + (total[0] + above[:, 0])
            down = np.cumsum(neg, axis=0) + (total[1] + above[:, 1])
            steps += np.where(pos > 0, pos * (up / np.maximum(up + down, 1)), 0.0).sum(axis=0)
            pairs += (neg * (up - 0.5 * pos)).sum(axis=0)
        total += np.stack([pos.sum(axis=0), neg.sum(axis=0)])
    return total[0], total[1], steps, pairs


def _splitmix64(x):
    """Vectorised splitmix64 finaliser on uint64 arrays (stable pseudo-random bits)."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        z = ((z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.uint64)
        z = ((z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)).astype(np.uint64)
        return z ^ (z >> np.uint64(31))


def sampled_shapley_batch(ids, x, background, weights, bias, n_perm: int, seed: int):
    """Permutation-sampling Shapley values of sigmoid(w.x + b) for a batch.

    ``x``: (B, d); ``background``: (n_bg, d). For every row, ``n_perm``
    permutations and background rows are drawn from splitmix64 of (id, seed),
    so results do not depend on batching. Per permutation the marginal gains
    telescope, hence sum(phi) = f(x) - base exactly.
    """
    import numpy as np

    w = np.asarray(weights, dtype="float64")
    b = float(bias)
    bg = np.asarray(background, dtype="float64")
    n, d = x.shape

    def f(v):
        return 1.0 / (1.0 + np.exp(-(v @ w + b)))

    row_seed = _splitmix64(np.asarray(ids, dtype="int64").astype(np.uint64)
                           ^ np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    phi = np.zeros((n, d))
    base = np.zeros(n)
    rows = np.arange(n)
    for m in range(n_perm):
        mix = _splitmix64(row_seed + np.uint64(m * (d + 1) + 1))
        pick = (mix % np.uint64(len(bg))).astype("int64")
        keys = np.stack([_splitmix64(mix + np.uint64(j + 1)) for j in range(d)], axis=1)
        perm = np.argsort(keys, axis=1, kind="stable")
        cur = bg[pick].copy()
        prev = f(cur)
        base += prev
        for t in range(d):
            j = perm[:, t]
            cur[rows, j] = x[rows, j]
            new = f(cur)
            phi[rows, j] += new - prev
            prev = new
    return phi / n_perm, base / n_perm, f(x)


def exact_shapley_batch(x, background, weights, bias):
    """Shapley values of sigmoid(w.x + b) by enumerating all subsets of the features.

    The value of a subset is the mean over the background rows of the model with the
    subset's features from x and the others from the background. Returns (phi, base, f(x)).
    """
    import math

    import numpy as np

    w, bg = np.asarray(weights, dtype="float64"), np.asarray(background, dtype="float64")
    n, d = x.shape
    masks = np.arange(1 << d)
    inside = (masks[:, None] >> np.arange(d)) & 1                       # (subset, feature)
    own, rest = (x * w) @ inside.T, (bg * w) @ (1 - inside).T + float(bias)
    value = np.empty((1 << d, n))
    for m in masks:
        value[m] = (1.0 / (1.0 + np.exp(-(own[:, m][:, None] + rest[:, m][None, :])))).mean(axis=1)
    share = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    phi = np.empty((n, d))
    for j in range(d):
        without = masks[inside[:, j] == 0]
        phi[:, j] = share[inside[without].sum(axis=1)] @ (value[without | (1 << j)] - value[without])
    return phi, value[0], value[-1]


MAX_EXACT = 12          # features whose subsets are enumerated


def attribute_exact(df, background, weights, bias, key: str = "TransactionID", x_col: str = "x"):
    """X2, exact: enumerated Shapley values of the probability for up to ``MAX_EXACT`` features;
    columns as :func:`attribute_sampled`, whose expectation they are."""
    import numpy as np

    if len(weights) > MAX_EXACT:
        raise ValueError(f"{len(weights)} features have too many subsets; sample instead")
    bg = np.asarray(background, dtype="float64")

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at:at + 1000]
                phi, base, pred = exact_shapley_batch(np.stack(part[x_col].to_numpy()).astype("float64"), bg,
                                                      weights, bias)
                yield pd.DataFrame({key: part[key].to_numpy(), "prediction": pred, "base_value": base,
                                    "contributions": list(phi)})

    schema = f"{key} long, prediction double, base_value double, contributions array<double>"
    return df.select(key, x_col).mapInPandas(run, schema)


def attribute_sampled(df, background, weights, bias, n_perm: int = 32, seed: int = 11,
                      key: str = "TransactionID", x_col: str = "x"):
    """Model-agnostic sampled attributions of the probability as Arrow
    batches (``mapInPandas``); the background (<= 100 rows) travels with the
    closure, the data never leaves its partition."""
    import numpy as np

    bg = np.asarray(background, dtype="float64")

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[x_col].to_numpy()).astype("float64")
            phi, base, pred = sampled_shapley_batch(pdf[key].to_numpy(), x, bg, weights, bias,
                                                    n_perm, seed)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "prediction": pred,
                                "base_value": base, "contributions": list(phi)})

    schema = f"{key} long, prediction double, base_value double, contributions array<double>"
    return df.select(key, x_col).mapInPandas(run, schema)
