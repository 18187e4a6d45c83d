"""twinscope: reconcile two versions of an artefact with Spark DataFrames."""
