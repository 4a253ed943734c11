"""The query language: syntax tree, parser and tooling."""
