"""Model families. Every fitted model has `score(df)`: for classification it adds
`probability` (array, one entry per class) and `prediction` (class index), for regression
`prediction`. Inputs are frames with a `features` vector and a numeric `label`."""
