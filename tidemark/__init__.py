"""Analytics over structured records, time series, forecasts and text, built from Spark DataFrames."""
