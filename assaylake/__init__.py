"""assaylake: evaluation analytics and training-data operators as Spark plans."""
