"""Nothing: graphs, rules and results are batch tables, and no operator of the engine has a streaming form."""
