"""Plan shapes shared by the operators: blocked series, range and as-of joins,
exact quantiles, stateful scans."""
