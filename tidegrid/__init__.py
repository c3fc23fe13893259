"""Point-in-time features, events and evaluation for market-like series, as Spark jobs.

Times are epoch microseconds in a long column `ts` unless said otherwise; series are keyed by `symbol`.
"""
