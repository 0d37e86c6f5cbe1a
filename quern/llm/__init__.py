"""Training-data operators over document tables. Nothing else in quern imports this."""
