"""Command line: profile tables of a database into reports, or one table to the console."""

from __future__ import annotations

import sys
from pathlib import Path

from .options import ProfileOptions

USAGE = """Reports for tables parted by commas:
  <driver-class> <jdbc-url> <user> <password> <database-label> <schema|-> <table1,table2,...> <output-root> [fetchSize]
Reports for a file of tables (UTF-8):
  <driver-class> <jdbc-url> <user> <password> <database-label> <default-schema|-> --table-file <file> <output-root> [fetchSize]
One table to the console:
  <driver-class> <jdbc-url> <user> <password> <schema> <table> [fetchSize]
In place of the driver class, "files" profiles <url>/<table>.parquet."""


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .operators.profile import profile_table
    from .plans.run import WORKBOOK, run
    from .sinks.console import print_profile
    from .sinks.html import INDEX
    from .sources import table_list
    from .sources.tables import JdbcSource, TableRef

    args = sys.argv[1:] if args is None else args
    by_file = len(args) > 6 and args[6] == "--table-file"
    if len(args) < 6 or by_file and len(args) < 9:
        print(USAGE, file=sys.stderr)
        return 2
    driver, url, user, password, *rest = args
    spark = SparkSession.builder.appName("gneiss").getOrCreate()

    def reader(options: ProfileOptions):
        if driver == "files":
            return lambda s, ref: s.read.parquet(f"{url}/{ref.table}.parquet")
        return lambda s, ref: JdbcSource(url, driver, user, password).read(s, ref, options)

    if len(args) < 8:
        ref = TableRef(table_list.default_schema(rest[0]), rest[1])
        options = ProfileOptions(fetch_size=int(rest[2])) if len(rest) > 2 else ProfileOptions()
        print_profile(ref.schema, ref.table, profile_table(reader(options)(spark, ref), options).collect())
        return 0
    label, schema = rest[:2]
    tables = table_list.read_file(rest[3], schema) if by_file else table_list.parse_commas(rest[2], schema)
    root, *size = rest[4:] if by_file else rest[3:]
    options = ProfileOptions(fetch_size=int(size[0])) if size else ProfileOptions()
    keys = None if driver == "files" else lambda ref: JdbcSource(url, driver, user, password).primary_keys(spark, ref)
    directory = Path(run(spark, label, tables, root, options, reader(options), keys)).resolve()
    print(f"Run saved to {directory}\nExcel: {directory / WORKBOOK}\nHTML : {directory / INDEX}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
