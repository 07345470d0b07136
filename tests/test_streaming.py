import hashlib
import os

from farewatch.config import H3Config
from farewatch.operators.rules.bursts import burst_windows
from farewatch.plans import tables
from farewatch.streaming.bursts import run_burst_rule_stream, run_burst_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    got = run_burst_stream(spark, SF, name="t_stream_" + hashlib.sha1(os.urandom(8)).hexdigest()[:6])
    cols = ["trm_id", "time_window", "tx_count", "unique_cards"]
    batch = burst_windows(tables.tx_norm(spark, SF), H3Config(exclude_service_cards=False))
    a, b = (sorted(map(tuple, x.select(cols).collect())) for x in (got, batch))
    assert a == b and len(a) > 0


def test_rule_stream_equals_the_batch_rule(spark):
    """Service cards' bursts are withdrawn; sample cards as the batch rule gives them."""
    cfg = H3Config(service_card_threshold=3)                 # some cards exceed it at this size
    got = run_burst_rule_stream(spark, SF, "t_rule_" + hashlib.sha1(os.urandom(8)).hexdigest()[:6], cfg)
    cols = ["trm_id", "time_window", "tx_count", "unique_cards", "sample_cards"]
    tx = tables.tx_norm(spark, SF)
    a, b, c = (sorted(map(str, x.select(cols).collect())) for x in (got, burst_windows(tx, cfg), burst_windows(tx, H3Config(exclude_service_cards=False))))
    assert a == b and 0 < len(a) and a != c
