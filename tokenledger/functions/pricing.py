"""Cost per call (P3, P4, P5) in exact decimal arithmetic.

cost = round_half_up((prompt * in + completion * out) * 0.001, 6), stored as
DECIMAL(12,6). The multiply by 0.001 (not a divide by 1000) keeps the result
type exact and equal across engines.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger import constants as K

PRICE_TYPE = "decimal(10,5)"
TOKEN_TYPE = "decimal(12,0)"
COST_TYPE = "decimal(12,6)"
COST_SUM_TYPE = "decimal(22,6)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _price(v: str) -> Column:
    return F.lit(Decimal(v)).cast(PRICE_TYPE)


def _price_map(d: dict[str, tuple[str, str]]) -> Column:
    kv = []
    for model, (pin, pout) in d.items():
        kv += [F.lit(model), F.struct(_price(pin).alias("pin"), _price(pout).alias("pout"))]
    return F.create_map(*kv)


def unit_prices(provider, model) -> tuple[Column, Column]:
    """(input, output) USD per 1K tokens; the default depends on the provider."""
    p, m = _col(provider), _col(model)
    a = F.element_at(_price_map(K.ANTHROPIC_PRICES), m)
    o = F.element_at(_price_map(K.OPENAI_PRICES), m)
    is_b = p == "anthropic"
    pin = F.when(is_b, F.coalesce(a["pin"], _price(K.ANTHROPIC_DEFAULT_PRICE[0]))) \
           .otherwise(F.coalesce(o["pin"], _price(K.OPENAI_DEFAULT_PRICE[0])))
    pout = F.when(is_b, F.coalesce(a["pout"], _price(K.ANTHROPIC_DEFAULT_PRICE[1]))) \
            .otherwise(F.coalesce(o["pout"], _price(K.OPENAI_DEFAULT_PRICE[1])))
    return pin, pout


def cost_from_prices(prompt_tokens, completion_tokens, pin, pout) -> Column:
    gross = (_col(prompt_tokens).cast(TOKEN_TYPE) * _col(pin).cast(PRICE_TYPE)
             + _col(completion_tokens).cast(TOKEN_TYPE) * _col(pout).cast(PRICE_TYPE))
    return F.round(gross * F.lit(Decimal("0.001")).cast("decimal(4,3)"), 6).cast(COST_TYPE)


def cost_usd(provider, model, prompt_tokens, completion_tokens) -> Column:
    """Cost of one call priced by its provider's table."""
    pin, pout = unit_prices(provider, model)
    return cost_from_prices(prompt_tokens, completion_tokens, pin, pout)


def total_tokens(prompt_tokens, completion_tokens) -> Column:
    """P5."""
    return (_col(prompt_tokens) + _col(completion_tokens)).alias("total_tokens")


def price_table(spark):
    """Price dimension in table form (8 rows + defaults keyed by provider, model null)."""
    rows = [("openai", m, Decimal(i), Decimal(o)) for m, (i, o) in K.OPENAI_PRICES.items()]
    rows += [("anthropic", m, Decimal(i), Decimal(o)) for m, (i, o) in K.ANTHROPIC_PRICES.items()]
    rows += [("openai", None, Decimal(K.OPENAI_DEFAULT_PRICE[0]), Decimal(K.OPENAI_DEFAULT_PRICE[1])),
             ("anthropic", None, Decimal(K.ANTHROPIC_DEFAULT_PRICE[0]), Decimal(K.ANTHROPIC_DEFAULT_PRICE[1]))]
    return spark.createDataFrame(rows, f"provider string, model string, price_in {PRICE_TYPE}, price_out {PRICE_TYPE}")
