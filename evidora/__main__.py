"""python -m evidora build FOLDER ISSUES.jsonl | ask FOLDER QUESTION... | health FOLDER"""

from __future__ import annotations

import json
import sys

from .plans.engine import Engine
from .session import local_session
from .sources import files


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("build", "ask", "health"):
        print(__doc__)
        return 2
    spark = local_session()
    engine = Engine(spark, args[1])
    if args[0] == "build":
        raw = spark.read.text(args[2]).withColumnRenamed("value", "raw")
        print(json.dumps({"records": engine.build(files.raw_issues(raw))}))
    elif args[0] == "ask":
        print(engine.ask(" ".join(args[2:]))["answer"])
    else:
        print(json.dumps(engine.health()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
