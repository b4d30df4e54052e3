"""python -m docketry EVIDENCE OUTPUT: decides a corpus of evidence (Parquet) into JSON lines."""

from __future__ import annotations

import sys

from .operators.policy import calibration_frame
from .session import local_session
from .sources.tables import read_evidence, write_predictions
from .streaming.arrivals import settle


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = local_session()
    write_predictions(settle(read_evidence(spark, arguments[0]), calibration_frame(spark)), arguments[1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
