"""DataFrame to DataFrame: cleaning, splits, spatial joins, aggregates, normalizers, predictors, clustering, tuning."""
