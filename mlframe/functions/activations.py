"""Elementwise activation functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual SELU constants.
SELU_ALPHA = 1.6732632423543772
SELU_LAMBDA = 1.0507009873554805


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(0.0))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def mish(x: Column) -> Column:
    # softplus in the form that does not overflow for large x
    softplus = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return x * F.tanh(softplus)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(alpha) * (F.exp(x) - 1.0))


def selu(x: Column, alpha: float = SELU_ALPHA, scale: float = SELU_LAMBDA) -> Column:
    return F.lit(scale) * elu(x, alpha)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(slope) * x)


ACTIVATIONS = {
    "sigmoid": sigmoid, "tanh": F.tanh, "relu": relu, "silu": silu,
    "mish": mish, "elu": elu, "selu": selu, "leaky_relu": leaky_relu,
}


def activation(col: str | Column, name: str, **params: float) -> Column:
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    return ACTIVATIONS[name](x, **params)
