"""Training scalars as column expressions over tables of steps or depths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Peak rate of the reference accelerator, reference batch and corpus of the batch rule and its exponent.
PEAK_FLOPS = 312e12
REFERENCE_BATCH = 524288
REFERENCE_TOKENS = 10_000_000_000
BATCH_EXPONENT = 0.383
# Learning rate at the reference batch and its least share; weight decay there and at most; warm-up.
PEAK_RATE, LEAST_SHARE = 6e-4, 0.1
WEIGHT_DECAY, MOST_DECAY = 0.1, 0.5
WARMUP, WARMUP_SHARE = (100, 2000), 0.05


def learning_rate(step: Column, peak: float, least: float, warmup: int, decay_until: int) -> Column:
    """Linear warm-up to ``peak``, then half a cosine down to ``least`` at ``decay_until``, then constant."""
    share = (step - warmup) / F.lit(float(decay_until - warmup))
    cosine = least + 0.5 * (1.0 + F.cos(F.lit(math.pi) * share)) * (peak - least)
    return F.when(step < warmup, peak * (step + 1) / F.lit(float(warmup + 1))).when(step > decay_until, F.lit(least)).otherwise(cosine)


def flops_utilisation(parameters: Column, layers: Column, heads: Column, head_dim: Column, block: Column, sequences: Column, seconds: Column) -> Column:
    """Share of the peak rate that a training iteration over ``sequences`` sequences of ``block`` tokens reaches."""
    per_token = 6.0 * parameters + 12.0 * layers * heads * head_dim * block
    return per_token * block * sequences / seconds / F.lit(PEAK_FLOPS)


def model_shape(depth: Column, head_dim: int = 64, aspect: int = 64) -> dict[str, Column]:
    """Width, heads and parameters of a transformer of ``depth`` layers whose width grows with depth."""
    width = F.ceil(depth * aspect / head_dim) * head_dim
    hidden = F.ceil(F.floor(8 * width / 3) / 256) * 256
    return {"n_layer": depth, "n_embd": width, "n_head": width / head_dim, "n_params": depth * (4 * width * width + 3 * width * hidden)}


def batch_tokens(target_tokens: Column, micro_tokens: int) -> Column:
    """Tokens of a batch: grows with the corpus by a power law, rounded to a power of two, at least one micro-batch."""
    predicted = REFERENCE_BATCH * F.pow(target_tokens / float(REFERENCE_TOKENS), F.lit(BATCH_EXPONENT))
    rounded = F.pow(F.lit(2.0), F.rint(F.log2(F.greatest(predicted, F.lit(float(micro_tokens))))))
    return F.greatest(rounded, F.lit(float(micro_tokens)))


def training_plan(parameters: Column, micro_tokens: int, tokens_per_parameter: float = 20.0, corpus_tokens: float | None = None, epochs: float | None = None) -> dict[str, Column]:
    """Training scalars of a model of so many parameters: tokens, batch, iterations, rates, weight decay and warm-up.

    ``corpus_tokens`` gives ``epochs_run``; ``epochs`` then limits the
    iterations to so many passes over the corpus.
    """
    tokens = F.floor(parameters * F.lit(float(tokens_per_parameter)))
    accumulation = F.greatest(F.lit(1), F.floor(batch_tokens(tokens.cast("double"), micro_tokens) / F.lit(micro_tokens)))
    batch = accumulation * micro_tokens
    iterations = F.greatest(F.lit(1), F.floor(tokens / batch))
    if corpus_tokens is not None and epochs is not None:
        iterations = F.least(iterations, F.greatest(F.lit(1), F.floor(F.lit(float(epochs * corpus_tokens)) / batch)))
    ratio = F.sqrt(batch / F.lit(float(REFERENCE_BATCH)))
    rate = F.lit(PEAK_RATE) * ratio
    decay = F.lit(WEIGHT_DECAY) * ratio * (F.lit(float(REFERENCE_TOKENS)) / tokens)
    plan = {
        "tokens": tokens,
        "accumulation": accumulation,
        "iterations": iterations,
        "learning_rate": rate,
        "least_rate": rate * LEAST_SHARE,
        "weight_decay": F.least(decay, F.lit(MOST_DECAY)),
        "warmup": F.greatest(F.lit(WARMUP[0]), F.least(F.lit(WARMUP[1]), F.floor(iterations * WARMUP_SHARE))),
    }
    return plan if corpus_tokens is None else plan | {"epochs_run": iterations * batch / F.lit(float(corpus_tokens))}
