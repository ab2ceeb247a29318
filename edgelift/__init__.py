"""edgelift: which missing edge of a labelled graph would add the most matches of a query graph?"""
