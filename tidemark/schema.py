"""Data model: the long KPI table, its series key and the KPI rule table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ["kpi", "dim_key"]
"""Key of one time series. After the hourly rollup a series holds at most one row per hour,
so a group or window over this key is bounded by the calendar (8,784 rows a year) however
many raw events fed it. Groups *across* series (all points of one KPI) are not bounded and
never go through a plain window or a grouped map."""

KPI_LONG = T.StructType(
    [
        T.StructField("kpi", T.StringType()),
        T.StructField("dim_key", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
    ]
)

KPI_RULE = T.StructType(
    [
        T.StructField("kpi", T.StringType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("bad_direction", T.StringType()),
    ]
)

# Per KPI, lower and upper bound and bad direction of its `_wmean` form, bad direction
# of its `_sum` and of its `_sample` form; `-` for none. Sums and samples are counts, bounded by [0, inf].
KPI_RULES = """
update_pdp_success 0 1 min min max
delete_pdp_success 0 1 min min max
ims_dereg_succ_ratio 0 1 min min max
ims_srvcc_succ_ratio 0 1 min min max
ims_reg_succ_ratio 0 1 min min max
ims_sess_change_succ_ratio 0 1 min min max
ims_rereg_succ_ratio 0 1 min min max
ims_sess_setup_succ_ratio 0 1 min min max
gnb_add_overall_succ_ratio 0 1 min min max
csfb_call_succ 0 1 min min max
srvcc_succ_ratio 0 1 min min max
attach 0 1 min min max
lte_attach 0 1 min min max
s1_ho 0 1 min min max
create_session 0 1 min min max
x2_ho 0 1 min min max
detach 0 1 min min max
harq_loss_dl 0 1 max max max
harq_loss_ul 0 1 max max max
rlc_loss_dl 0 1 max max max
rlc_loss_ul 0 1 max max max
pkt_loss_net_ul 0 1 max max max
pkt_loss_term_dl 0 1 max max max
pkt_loss_term_ul 0 1 max max max
pkt_loss_net_dl 0 1 max max max
rtp_packet_loss_dl 0 1 max max max
rtp_packet_loss_ul 0 1 max max max
pdcp_loss_dl 0 1 max max max
pdcp_loss_ul 0 1 max max max
abnormal_lte_conn_rel_ratio 0 1 max max max
ims_abnorm_sess_rel_ratio 0 1 max max max
enb_init_gnb_mod_dur 0 inf max max max
gnb_add_overall_duration 0 inf max max max
gnb_change_dur 0 inf max max max
gnb_init_gnb_mod_dur 0 inf max max max
ims_srvcc_delay 0 inf max max max
ims_sess_change_delay 0 inf max max max
ims_reg_delay 0 inf max max max
ims_dereg_delay 0 inf max max max
ims_call_setup_delay 0 inf max max max
ims_rereg_delay 0 inf max max max
rtp_delay_ul 0 inf max max max
rtp_delay_dl 0 inf max max max
rtt_net 0 inf max max max
rtt_term 0 inf max max max
delete_session_response_time 0 inf max max max
s1_ho_exec_time 0 inf max max max
x2_ho_exec_time 0 inf max max max
ims_call_setup_time 0 inf max max max
rtp_jitter_dl 0 inf max max max
rtp_jitter_ul 0 inf max max max
pdcp_tp_dl 0 inf min min max
pdcp_tp_ul 0 inf min min max
tcp_tp_dl 0 inf min min max
tcp_tp_ul 0 inf min min max
udp_tp_class_ul 0 inf min min max
udp_tp_class_dl 0 inf min min max
tcp_tp_class_dl 0 inf - - -
tcp_tp_class_ul 0 inf min min max
x2_ho_attempts 1 inf max max max
s1_ho_attempts 1 inf max max max
bytes_dl - - - max max
bytes_ul - - - max max
rsrp -140 -43 min min min
serving_rsrp -140 -43 min min min
rsrq -19.5 -2.5 min min min
serving_rsrq -19.5 -2.5 min min min
rtp_mos_dl 1 5 min min max
rtp_mos_ul 1 5 min min max
""".split("\n")[1:-1]
# A KPI with a bad direction and without bounds or forms.
DIRECTION_ONLY = ("x2_ho_avg", None, None, "min")


def kpi_rule_rows() -> list[tuple[str, float | None, float | None, str | None]]:
    """One rule per form of every KPI."""
    rows = []
    for line in KPI_RULES:
        base, lower, upper, *bad = line.split()
        mean, total, sample = (None if b == "-" else b for b in bad)
        if lower != "-":
            rows.append((f"{base}_wmean", float(lower), float(upper), mean))
        rows += [(f"{base}_sum", 0.0, math.inf, total), (f"{base}_sample", 0.0, math.inf, sample)]
    return [*rows, DIRECTION_ONLY]


def kpi_rules(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The rule table; a few hundred rows fixed by the schema, so it is broadcast safely."""
    return spark.createDataFrame(kpi_rule_rows() + list(extra), KPI_RULE)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hourly_wide(events: DataFrame, dim: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Roll raw observations up to one row per (dimension value, hour).

    The aggregate combines map-side, so a dimension value holding a third of all events
    still sends at most one row per task and hour into the shuffle.
    """
    return events.groupBy(F.col(dim).alias("dim_key"), hour_of(F.col(ts)).alias("ts")).agg(
        F.round(F.avg(value), 9).alias("value_wmean"),
        F.round(F.sum(value), 9).alias("value_sum"),
        F.count(F.lit(1)).cast("double").alias("value_sample"),
    )


def to_long(wide: DataFrame, kpis: list[str]) -> DataFrame:
    """Wide KPI table -> canonical long table."""
    return wide.unpivot(["dim_key", "ts"], kpis, "kpi", "value").select(
        "kpi", "dim_key", "ts", "value"
    )
