"""The posting tables read out of the given star schema, and the registered queries over them."""
