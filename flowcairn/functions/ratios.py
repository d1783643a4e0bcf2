"""Flow ratios: bytes and packets per second, packet size and direction balance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.names import trim_names
from flowcairn.functions.numeric import quoted

RATIO_COLUMNS = ("Flow_Bytes_s", "Flow_Packets_s", "Avg_Packet_Size", "Traffic_Direction_Ratio")


@dataclass(frozen=True)
class RatioInputs:
    """Accepted column names per role; the first one present is taken.

    ``upper``/``lower`` name the two directions as numerator and denominator of the direction ratio.
    """

    upper_bytes: tuple[str, ...]
    lower_bytes: tuple[str, ...]
    upper_packets: tuple[str, ...]
    lower_packets: tuple[str, ...]
    duration: tuple[str, ...]
    source: int

    def resolve(self, columns: list[str]) -> dict[str, str] | None:
        found = {}
        for role in ("upper_bytes", "lower_bytes", "upper_packets", "lower_packets", "duration"):
            name = next((n for n in getattr(self, role) if n in columns), None)
            if name is None:
                return None
            found[role] = name
        return found


# Column names of the two feeds; the direction ratio is forward/backward in the
# multi-file feed and out/in in the single-file feed.
MULTI_FILE = RatioInputs(
    upper_bytes=("Total Fwd Bytes", "Total Length of Fwd Packets"),
    lower_bytes=("Total Bwd Bytes", "Total Length of Bwd Packets"),
    upper_packets=("Total Fwd Packets",),
    lower_packets=("Total Bwd Packets", "Total Backward Packets"),
    duration=("Flow Duration",),
    source=0,
)
SINGLE_FILE = RatioInputs(
    upper_bytes=("bytes_out", "dst_bytes"),
    lower_bytes=("bytes_in", "src_bytes"),
    upper_packets=("pkts_out", "dst_pkts"),
    lower_packets=("pkts_in", "src_pkts"),
    duration=("duration",),
    source=1,
)


def with_flow_ratios(df: DataFrame, inputs: RatioInputs, eps: float = 1e-8) -> DataFrame:
    """Add the four ratios and ``dataset_source``; without the needed inputs only the source tag."""
    df = trim_names(df)
    found = inputs.resolve(df.columns)
    if found is None:
        return df.withColumn("dataset_source", F.lit(inputs.source))
    up_b, low_b, up_p, low_p, duration = (F.col(quoted(found[r])) for r in found)

    def at_least_eps(c):  # greatest() would turn a missing divisor into eps
        return F.when(c < eps, F.lit(eps)).otherwise(c)

    return df.withColumns(
        {
            "Flow_Bytes_s": (up_b + low_b) / at_least_eps(duration),
            "Flow_Packets_s": (up_p + low_p) / at_least_eps(duration),
            "Avg_Packet_Size": (up_b + low_b) / at_least_eps(up_p + low_p),
            "Traffic_Direction_Ratio": F.try_divide(up_b, low_b + F.lit(eps)),
            "dataset_source": F.lit(inputs.source),
        }
    )
