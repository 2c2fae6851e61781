"""DataFrame to DataFrame: joins, rollups, ranked lists, upserts, sweeps."""
