"""Tessella: analytics over keyed tables, embeddings, trials, segments and text on PySpark."""
