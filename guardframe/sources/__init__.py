"""Where rows come from: tables, configuration, tokenizer files, bundles."""
