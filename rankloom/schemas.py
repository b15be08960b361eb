"""Table schemas, and constants that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_LIST = T.ArrayType(_S)

RATINGS_CSV = _struct(user_id=_S, parent_asin=_S, rating=_D, timestamp=_L, history=_S)
RATINGS = _struct(user_id=_S, parent_asin=_S, rating=_D, timestamp=_L, source_split=_S)
META = _struct(parent_asin=_S, title=_S, features=_LIST, description=_LIST, store=_S, categories=_LIST, price=_S, main_category=_S, details=_S)
COHORT = _struct(user_id=_S, query_time=_TS, n_prior=_L, n_pos=_L)
POOLS = _struct(user_id=_S, query_time=_TS, rank=_L, parent_asin=_S, l1_score=_D, source=_S)
SCORES = _struct(user_id=_S, parent_asin=_S, l1_rank=_L, score=_D)
EXAMPLES = _struct(query_id=_L, query=_S, product_id=_S, product_locale=_S, esci_label=_S, small_version=_I, split=_S)
PRODUCTS = _struct(product_id=_S, product_title=_S, product_description=_S, product_bullet_point=_S, product_brand=_S, product_color=_S, product_locale=_S)
MANIFEST = _struct(run_id=_S, model=_S, model_version=_S, scoring_mode=_S, started_at=_S, split=_S, setting=_S, pool_sha256=_S, eval_cohort=_S, eval_cohort_sha256=_S, n_users_full_cohort=_L, failures=_L, retries=_L, input_tokens=_L, cost_usd=_D)

#: Columns that an item table must not have: they tell of the future (fixed values).
FORBIDDEN_ITEM_FIELDS = ("average_rating", "rating_number", "bought_together", "images")
#: Cut points of the published split in Unix milliseconds, and of the provided tables.
VALID_START_MS, TEST_START_MS = 1628643414042, 1658002729837
VALID_START, TEST_START = "2000-07-01 00:00:00", "2001-01-01 00:00:00"
MIN_PRIOR, MIN_POS, LIKE, DISLIKE = 3, 1, 4, 2
MAX_LIKED, MAX_DISLIKED, PROFILE_TOKENS, ITEM_TOKENS = 10, 3, 352, 160
HALF_LIFE_DAYS, WINDOW_DAYS, STORED_M, EVAL_M, ANN_GATE = 180.0, 90, 200, 100, 0.95
RRF_K, GRID = 60, tuple(i / 10 for i in range(11))
N_RESAMPLES, SIGNIFICANCE = 10_000, 0.05
GAINS = {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}
#: Models outside the family of tests.
NOT_TESTED = ("l1_order", "oracle")
