"""mnemolake: conversation-memory analytics and training-data operators on Spark DataFrames."""
