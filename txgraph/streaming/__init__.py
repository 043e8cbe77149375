"""txgraph.streaming"""
